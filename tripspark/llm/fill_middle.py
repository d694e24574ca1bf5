"""Fill-in-middle: documents cut at token boundaries and put together as prefix, suffix and middle.

A text is split into chunks where a rolling hash of its last 16 bytes says so,
so equal passages give equal chunks wherever they stand. Each task keeps a
cache from a chunk's content to its boundary summary: how many tokens begin in
it, how many code points it has, and whether it begins and ends with a letter.
Summaries add up to the counts of a text (a run of letters that goes on across
a border counts once), and the sums name the chunk that a cut falls into; only
that chunk is looked at again. No shuffle, and no text is held beyond its batch.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripspark.llm.common import documents, free_memory, small_batches

WINDOW, LEAST, MOST = 16, 64, 8192  # bytes of the rolling hash; of a chunk
RARE = np.uint64(1 << 55)  # hashes below end a chunk: one position of 512
STEP = 0x9E3779B97F4A7C15 | 1
WORTH = np.random.default_rng(12345).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
PIECE = 1 << 20  # bytes of a text that are hashed at a time
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
MARKS = ("<P>", "<S>", "<M>")


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """The hash of the last 16 bytes at each byte, by doubling the window."""
    h = WORTH[data]
    width = 1
    while width < WINDOW:
        longer = h.copy()
        longer[width:] += h[:-width] * np.uint64(pow(STEP, width, 1 << 64))
        h, width = longer, 2 * width
    return h


def chunk_ends(data: np.ndarray) -> list[int]:
    """Where the chunks of a text end; the last ends with the text."""
    ends, at, n = [], 0, len(data)
    for lo in range(0, n, PIECE):
        back = min(lo, WINDOW - 1)
        h = rolling_hash(data[lo - back : lo + PIECE])[back:]
        for end in (np.flatnonzero(h < RARE) + lo + 1).tolist():
            while end - at > MOST:
                at += MOST
                ends.append(at)
            if end - at >= LEAST:
                at = end
                ends.append(at)
    while n - at > MOST:
        at += MOST
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def token_starts(data: np.ndarray, in_word: bool) -> np.ndarray:
    """Where tokens begin: a letter not after a letter, any other code point. ``in_word``: the byte before is a letter."""
    letter = LETTER[data]
    before = np.empty_like(letter)
    before[:1], before[1:] = in_word, letter[:-1]
    return np.flatnonzero(np.where(letter, ~before, (data & 0xC0) != 0x80))


class ChunkCache:
    """Boundary summaries by content; begun anew when its contents exceed ``most_bytes``."""

    def __init__(self, most_bytes: int = 32 << 20) -> None:
        self.kept: dict[bytes, tuple[int, int, bool, bool]] = {}
        self.bytes, self.most_bytes = 0, most_bytes

    def summary(self, chunk: bytes) -> tuple[int, int, bool, bool]:
        """Tokens that begin in the chunk (after a non-letter), code points, letter first, letter last. A hit has equal content, not just an equal hash."""
        found = self.kept.get(chunk)
        if found is None:
            data = np.frombuffer(chunk, np.uint8)
            found = (len(token_starts(data, False)), int(((data & 0xC0) != 0x80).sum()), bool(LETTER[data[0]]), bool(LETTER[data[-1]]))
            if self.bytes > self.most_bytes:
                self.kept, self.bytes = {}, 0
            self.kept[chunk] = found
            self.bytes += len(chunk)
        return found


class Chunked:
    """A text as its chunks' summaries, combined."""

    def __init__(self, text: bytes, cache: ChunkCache) -> None:
        self.text, data = text, np.frombuffer(text, np.uint8)
        self.ends = chunk_ends(data)
        tokens, chars, in_word, self.open = [], [], False, []
        for lo, hi in zip([0, *self.ends], self.ends):
            n, c, first, last = cache.summary(text[lo:hi])
            tokens.append(n - (in_word and first))  # a word that goes on began before
            chars.append(c)
            self.open.append(in_word)
            in_word = last
        self.tokens, self.chars = [0, *accumulate(tokens)], [0, *accumulate(chars)]
        self.n = self.tokens[-1]

    def cut(self, k: int) -> tuple[int, int]:
        """Byte and code point at which token ``k`` (from 0) begins; the text's end for k = n."""
        if k >= self.n:
            return len(self.text), self.chars[-1]
        c = bisect_right(self.tokens, k) - 1
        lo = self.ends[c - 1] if c else 0
        data = np.frombuffer(self.text[lo : self.ends[c]], np.uint8)
        at = int(token_starts(data, self.open[c])[k - self.tokens[c]])
        return lo + at, self.chars[c] + int(((data[:at] & 0xC0) != 0x80).sum())


def arranged(doc_id: object, text: str, cache: ChunkCache, fim_percent: int, spm_percent: int) -> tuple:
    """n, form, prefix_chars, middle_chars and output of one document."""
    raw = text.encode()
    whole = Chunked(raw, cache)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in MARKS) or h3 % 100 >= fim_percent:
        return whole.n, "plain", None, None, text
    a, b = sorted((h1 % (whole.n + 1), h2 % (whole.n + 1)))
    (b1, c1), (b2, c2) = whole.cut(a), whole.cut(b)
    prefix, middle, suffix = raw[:b1].decode(), raw[b1:b2].decode(), raw[b2:].decode()
    if h4 % 100 < spm_percent:
        return whole.n, "spm", c1, c2 - c1, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return whole.n, "psm", c1, c2 - c1, f"<P>{prefix}<S>{suffix}<M>{middle}"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fim_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, n, form, prefix_chars, middle_chars, output.

    Tokens are runs of A-Z and a-z, and single other code points. The cuts, whether a
    document is rearranged (``fim_percent`` of them) and in which form (``spm_percent``
    of those ``spm``) hang on a hash of its id alone. A text that is empty or holds a mark stays plain, with
    null counts. A null text is the empty one; a null id is hashed as the empty string.
    Rows that repeat an id are cut at the same shares of their own tokens. An empty
    table gives no rows. Other columns are not read.
    """
    small_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = ChunkCache()
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                rows = [arranged(i, t, cache, fim_percent, spm_percent) for i, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                n, form, prefix, middle, output = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
        del cache
        free_memory()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(id_col).cast("string").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: str = "output", form: str = "form"):
    """The text that was rearranged, as a column: each mark stands once in a rearranged output."""
    between = lambda a, b: F.substring_index(F.substring_index(F.col(output), b, 1), a, -1)
    after = lambda a: F.substring_index(F.col(output), a, -1)
    psm = F.concat(between("<P>", "<S>"), after("<M>"), between("<S>", "<M>"))
    spm = F.concat(between("<P>", "<M>"), after("<M>"), between("<S>", "<P>"))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(documents(spark, sf_dir))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


#: Tokens as a list, cut by slices.
ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
u AS (SELECT *, CASE WHEN text = '' THEN CAST([] AS VARCHAR[]) ELSE regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') END AS us,
  [CAST('0x' || substr(d, 1 + 8 * k, 8) AS BIGINT) FOR k IN range(4)] AS h FROM t),
c AS (SELECT *, len(us) AS n, least(h[1] % (len(us) + 1), h[2] % (len(us) + 1)) AS a, greatest(h[1] % (len(us) + 1), h[2] % (len(us) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
s AS (SELECT *, array_to_string(us[1:a], '') AS p, array_to_string(us[a + 1:b], '') AS m, array_to_string(us[b + 1:n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM s
"""
