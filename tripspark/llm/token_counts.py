"""Token counts by prefix dynamic programming over a piece (BPE) vocabulary.

For every prefix of a text there is one last token, and the count of a prefix
is the count of the prefix before that token plus one (``merge_automaton``). The
counts of all prefixes answer how much of a text fits a budget, or what a
truncated text costs, without encoding again. No piece of the vocabulary holds a
word mark after another letter, so texts fall apart into words whose tables
are computed once a task and added up. Works row by row: no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from tripspark.llm.common import documents, free_memory, hold, small_batches
from tripspark.llm.merge_automaton import MergeAutomaton

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: Words kept in a task's table of counted words before it is begun anew; it is dropped at the end of the task.
KEPT_WORDS = 400_000


class Pieces:
    """A sentencepiece BPE model with byte fallback, the identity normaliser and a mark before the text."""

    def __init__(self, path: str):
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError("only the identity normaliser with a mark before the text is supported")
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback:
            raise ValueError("only BPE with byte fallback is supported")
        normal = [(p.score, p.piece) for p in proto.pieces if p.type == 1]
        # runs of marks merge last and among themselves: see blanks()
        self.runs = {p: s for s, p in normal if set(p) == {MARK} and len(p) > 1}
        words = [(s, p) for s, p in normal if p not in self.runs]
        if any(MARK in p[1:] for _, p in words):
            raise ValueError("a piece holds a mark after another letter")
        letters = sorted({c for _, p in words for c in p})
        single = {p for _, p in words if len(p) == 1}
        self.unit = {c: i for i, c in enumerate(letters)}
        #: Letters of longer pieces that are no pieces themselves: alone they cost their bytes.
        self.bare = {c for c in letters if c not in single}
        ranked = [p for _, p in sorted(((-s, p) for s, p in words if len(p) > 1), key=lambda x: x[0])]
        token = dict(self.unit) | {p: len(letters) + r for r, p in enumerate(ranked)}
        rank = {p: r for r, p in enumerate(ranked)}
        pairs = {}
        for p, r in rank.items():
            for k in range(1, len(p)):
                if (u := token.get(p[:k])) is not None and (v := token.get(p[k:])) is not None:
                    pairs[u, v] = r
        merges = []
        for p in ranked:
            parts = list(p)
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda i: rank.get(parts[i] + parts[i + 1], 1 << 30))
                if rank.get(parts[best] + parts[best + 1], 1 << 30) >= rank[p]:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            merges.append((token[parts[0]], token[parts[1]], token[p]) if len(parts) == 2 else (len(letters), len(letters), token[p]))
        self.automaton = MergeAutomaton(len(letters), merges, pairs)
        self.mark = self.unit[MARK]
        self.forget()
        if "\n" in self.unit:
            raise ValueError("the vocabulary has a piece with a line break")
        self.split = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+").findall

    def forget(self) -> None:
        self.known: dict[str, int] = {"\n": 1, "": 0}

    def blanks(self, n: int) -> int:
        """Tokens of n marks: the pair of highest score merges first, of equal ones the leftmost."""
        import heapq

        if n < 2:
            return n
        length, nxt, prev, heap, left = [1] * n, [*range(1, n), -1], [-1, *range(n - 1)], [], n

        def push(i: int) -> None:
            if i != -1 and nxt[i] != -1 and (s := self.runs.get(MARK * (length[i] + length[nxt[i]]))) is not None:
                heapq.heappush(heap, (-s, i, length[i], length[nxt[i]]))

        longest = max(map(len, self.runs), default=1)
        for i in range(n):
            push(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if length[i] != a or j == -1 or length[j] != b or a + b > longest:
                continue
            length[i], length[j], nxt[i], left = a + b, 0, nxt[j], left - 1
            if nxt[i] != -1:
                prev[nxt[i]] = i
            push(prev[i])
            push(i)
        return left

    def units(self, word: str) -> np.ndarray:
        """Units of the word; what has no piece is minus its number of bytes."""
        get = self.unit.get
        return np.array([u if (u := get(c)) is not None and c not in self.bare else -len(c.encode()) for c in word], np.int64)

    def learn(self, segments: set[str]) -> None:
        """Count segments that are not in the table yet; a segment is marks and then other letters."""
        new = [s for s in segments if s not in self.known]
        marks = [len(s) - len(s.lstrip(MARK)) for s in new]
        words = [self.units(s[max(0, m - 1) :]) for s, m in zip(new, marks)]
        tokens, counts = self.automaton.batch(words)
        for s, m, t, c in zip(new, marks, tokens, counts):
            c = int(c)
            if m > 1:
                # the last mark stays with the word only if they merge
                alone = len(t) > 0 and int(t[0]) == self.mark
                c += self.blanks(m) - 1 if alone else self.blanks(m - 1)
            self.known[s] = c

    def segments(self, text: str) -> list[str]:
        return self.split(MARK + text.replace(" ", MARK)) if text else []

    def count(self, texts: list[str]) -> list[int]:
        split = [self.segments(t) for t in texts]
        if len(self.known) > KEPT_WORDS:
            self.forget()
        known = self.known
        self.learn({s for segments in split for s in segments})
        return [sum(map(known.__getitem__, segments)) for segments in split]

    def prefix_counts(self, text: str) -> list[int]:
        """Exact token counts of all prefixes of the text, by number of characters; the empty one costs nothing."""
        out, total = [0], 0
        for k, segment in enumerate(self.segments(text)):
            if segment == "\n":
                total += 1
                out.append(total)
                continue
            m = len(segment) - len(segment.lstrip(MARK))
            first = 2 if k == 0 else 1  # the mark before the text is no character of it
            out += [total + self.blanks(x) for x in range(first, m + 1)]
            if m < len(segment):
                word = segment[max(0, m - 1) :]
                last, count = self.automaton.prefixes(self.units(word).tolist())
                head = 1 if m else 0
                path_alone = self._first_alone(last, word)
                for i in range(head + 1, len(word) + 1):
                    extra = 0 if m < 2 else self.blanks(m) - 1 if path_alone[i] else self.blanks(m - 1)
                    out.append(total + count[i] + extra)
            self.learn({segment})
            total += self.known[segment]
        return out

    def _first_alone(self, last: list[int], word: str) -> list[bool]:
        """Of every prefix: is its first token the mark alone?"""
        out = [False] * (len(word) + 1)
        for i in range(1, len(word) + 1):
            size = self.automaton.depth_of(last[i]) if last[i] != -1 else 1
            out[i] = (i == 1 and last[1] == self.mark) if i - size == 0 else out[i - size]
        return out


def _map(docs: DataFrame, path: str | None, id_col: str, text_col: str, schema: str, row_of) -> DataFrame:
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = hold(("pieces", path), lambda: Pieces(path))
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield pa.RecordBatch.from_arrays(*row_of(model, part.column(0), [t or "" for t in part.column(1).to_pylist()]))
        model.forget()
        free_memory()

    small_batches(docs)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def token_counts(docs: DataFrame, limit: int = 4096, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    No begin, end or other special tokens; their strings in a text are ordinary
    text. A null text is empty: 0 tokens. Texts are counted whole at any length.
    Null and repeated ids stay as they are. An empty table gives no rows. Other
    columns are not read. ``path``: the model file, on every executor.
    """

    def rows(model: Pieces, ids: pa.Array, texts: list[str]):
        n = model.count(texts)
        return [ids, pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"]

    return _map(docs, path, id_col, text_col, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", rows)


def prefix_token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, prefix_tokens: an array with the token count of every prefix, from 0 to all characters. Edge cases as in token_counts."""

    def rows(model: Pieces, ids: pa.Array, texts: list[str]):
        return [ids, pa.array([model.prefix_counts(t) for t in texts], pa.list_(pa.int32()))], ["doc_id", "prefix_tokens"]

    return _map(docs, path, id_col, text_col, "doc_id bigint, prefix_tokens array<int>", rows)


def fit_budget(counted: DataFrame, budget: int) -> DataFrame:
    """For the rows of prefix_token_counts: fit_chars, the length of the longest prefix of at most ``budget`` tokens."""
    fit = F.expr(f"array_max(filter(transform(prefix_tokens, (n, i) -> if(n <= {int(budget)}, i, -1)), i -> i >= 0))")
    return counted.withColumn("fit_chars", fit.cast("bigint"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
