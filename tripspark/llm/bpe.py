"""BPE encoding and decoding by a tokenization automaton.

The merges of a public word-level BPE vocabulary are compiled, gadget by gadget, into
the automaton of ``tokenization_automaton``; texts are split into words, distinct
words are encoded by its table, and tokens are decoded by writing out the labels of
the path's arcs. Works row by row, so Spark only partitions it: no shuffle.

Words are found with Python's Unicode tables. The library that the vocabulary is
made for has tables of its own; texts with a character on which the two do not agree
(``odd_characters``, or one that Python does not know) are split by the library's
own normaliser and splitter.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from tripspark.llm.common import documents, free_memory, hold, small_batches
from tripspark.llm.tokenization_automaton import TokenizationAutomaton

VOCABULARY = "word_bpe_49k.json"
#: Encoded words in a table; a full one is kept beside its follower, to which the words that are met again move. Both are dropped at the end of a task.
KEPT_WORDS = 60_000
#: What a vocabulary file must say to be read as this module reads it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPEC = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "decoder": None,
}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}

_plain_words = regex.compile(PATTERN).findall


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


def words_by_python(text: str) -> list[str]:
    # lower-casing is letter by letter: a final capital sigma is no special case
    return _plain_words(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())


@lru_cache(1)
def _library_parts() -> tuple:
    normal = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
    return normal, pre_tokenizers.Split(Regex(PATTERN), "removed", invert=True), normalizers.NFC()


def words_by_library(text: str) -> list[str]:
    normal, split, _ = _library_parts()
    return [w for w, _ in split.pre_tokenize_str(normal.normalize_str(text))]


def known_to_python(c: str) -> bool:
    return unicodedata.category(c) not in ("Cn", "Cs")


@lru_cache(1)
def odd_characters() -> frozenset[str]:
    """Characters Python knows that it splits, lower-cases, orders or composes in another way than the library."""
    nfc = _library_parts()[2].normalize_str
    known = [c for c in map(chr, range(0x80, 0x110000)) if known_to_python(c)]
    odd: set[str] = set()

    def compare(part: list[str]) -> None:
        if words_by_python(text := " ".join(f"a{c}b {c} {c}{c}" for c in part)) != words_by_library(text):
            if len(part) == 1:
                odd.update(part)
            else:
                compare(part[: len(part) // 2])
                compare(part[len(part) // 2 :])

    for lo in range(0, len(known), 4096):
        compare(known[lo : lo + 4096])
    for c in known:
        if unicodedata.combining(c):  # its place among other marks
            probes = [f"q{a}" for a in (f"{c}̣", f"́{c}", f"{c}̴", f"ͅ{c}", f"{c}̧", f"̧{c}", f"̣{c}", f"{c}́")]
        elif unicodedata.decomposition(c) and not unicodedata.decomposition(c).startswith("<"):
            probes = [c, unicodedata.normalize("NFD", c), f"{c}̣", f"{c}́"]
        else:
            continue
        if any(nfc(p) != unicodedata.normalize("NFC", p) for p in probes):
            odd.add(c)
    return frozenset(odd)


class WordBpe:
    """A word-level BPE with word-end units: unit b is byte b inside a word, 256 + b the byte that ends it."""

    def __init__(self, path: str, odd: frozenset[str] | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        wrong = [k for k, v in SPEC.items() if spec.get(k) != v] + [k for k, v in MODEL.items() if model.get(k, v) != v]
        wrong += [k for k, v in ADDED.items() for t in spec["added_tokens"] if t.get(k) != v]
        self.end = model["end_of_word_suffix"]
        if wrong or not self.end:
            raise ValueError(f"{path}: not a word-level BPE as this operator reads it ({', '.join(wrong) or 'no word end'})")
        vocab = model["vocab"]
        letters = byte_letters()
        self.labels = [*letters, *(c + self.end for c in letters)]
        token = {label: t for t, label in enumerate(self.labels)}
        merges = []
        for m in model["merges"]:
            left, right = m if isinstance(m, list) else m.split(" ")
            made = left + right
            if made not in token:
                token[made] = len(self.labels)
                self.labels.append(made)
            merges.append((token[left], token[right], token[made]))
        self.automaton = TokenizationAutomaton(512, merges)
        if missing := [label for label in self.labels if label not in vocab]:
            raise ValueError(f"{path}: no ids for {missing[:5]}")
        self.ids = np.array([vocab[label] for label in self.labels], "<u4")
        self.label_of = {int(i): label for i, label in zip(self.ids, self.labels)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label_of.update({i: s for s, i in self.special.items()})
        self.split_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.odd = odd_characters() if odd is None else odd
        self.agreed = {chr(c) for c in range(128)}
        self.forget()

    def forget(self) -> None:
        """Drop the tables of encoded words; the automaton's table is kept, its size is bounded."""
        self._begin()
        self.before: dict[str, tuple[bytes, str]] = {}

    def _begin(self) -> None:
        self.known: dict[str, tuple[bytes, str]] = {"\0" + s: (np.uint32(i).astype("<u4").tobytes(), s) for s, i in self.special.items()}

    def words(self, text: str) -> list[str]:
        """The text's words; a special token is a word of its own, with a zero byte before it."""
        if self.split_special is None or not self.split_special.search(text):
            return self._plain(text)
        out = []
        for part in self.split_special.split(text):
            if part in self.special:
                out.append("\0" + part)
            elif part:
                out += self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if not text.isascii() and (new := set(text) - self.agreed):
            if any(c in self.odd or not known_to_python(c) for c in new):
                return words_by_library(text)
            self.agreed |= new
        return words_by_python(text)

    def learn(self, words: set[str]) -> None:
        """Encode words that are not in the table yet."""
        encode, ids, labels, known, before = self.automaton.encode, self.ids, self.labels, self.known, self.before.get
        for w in words - known.keys():
            found = before(w)
            if found is None:
                units = list(w.encode())
                units[-1] += 256
                path = encode(units)
                found = (ids[path].tobytes(), " ".join([labels[t] for t in path]))
            known[w] = found

    def encode_many(self, texts: list[str], most: int = 1 << 19) -> Iterator[tuple[bytes, str]]:
        """The ids (little-endian, four bytes each) and the decoded text of each text; about ``most`` characters of texts at a time."""
        part: list[str] = []
        size = 0
        for text in texts:
            part.append(text)
            size += len(text)
            if size >= most:
                yield from self._together(part)
                part, size = [], 0
        yield from self._together(part)

    def _together(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        split = [self.words(t) for t in texts]
        if len(self.known) > KEPT_WORDS:
            self.before = self.known
            self._begin()
        self.learn({w for words in split for w in words})
        get = self.known.__getitem__
        for words in split:
            found = list(map(get, words))
            yield b"".join([f[0] for f in found]), " ".join([f[1] for f in found])

    def decode(self, ids: bytes) -> str:
        """The labels of the path's arcs, as the vocabulary without a decoder writes them."""
        return " ".join([self.label_of[i] for i in np.frombuffer(ids, "<u4").tolist()])


def bpe_encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids (array, if keep_ids), ids_sha256, decoded_sha256 and (if keep_ids) decoded.

    Special strings inside a text become their tokens, no others are added. A null
    text is empty: no tokens. Texts are processed whole at any length. Null and
    repeated ids stay as they are. An empty table gives no rows. Other columns
    are not read, whatever their names. ``path``: the vocabulary file, on every
    executor; one with another normaliser, splitter or model than this module's is
    an error. ``carry``: columns of ``docs`` that come along as they are.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")
    odd = odd_characters()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = hold(("bpe", path), lambda: WordBpe(path, odd))
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                n, ids_sha, text_sha, ids, decoded = [], [], [], [], []
                for own, text in model.encode_many(texts):
                    n.append(len(own) // 4)
                    ids_sha.append(hashlib.sha256(own).hexdigest())
                    text_sha.append(hashlib.sha256(text.encode()).hexdigest())
                    if keep_ids:
                        ids.append(np.frombuffer(own, "<u4").astype(np.int32))
                        decoded.append(text)
                out = [part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    out += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                    names += ["ids", "decoded"]
                for k, c in enumerate(carry):
                    out.append(part.column(2 + k))
                    names.append(c)
                yield pa.RecordBatch.from_arrays(out, names=names)
        model.forget()
        free_memory()

    small_batches(docs)
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), *carry).mapInArrow(run, schema)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(documents(spark, sf_dir), keep_ids=False)
