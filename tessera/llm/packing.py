"""Packing tokenised documents into sequences as a cutting-stock problem, by column generation.

1. Each document is tokenised once, cut every SEQUENCE tokens, and its last piece goes by its length. Lengths count in
   units of UNIT tokens, so that their histogram is of fixed size however many pieces there are.
2. On this histogram a linear program over patterns (how many pieces of each length share a sequence) is solved with
   column generation: knapsack dynamic programming finds the pattern that the program's prices value most, until none
   is worth more than a sequence. The patterns' counts are rounded down; what is left over, a few sequences' worth for
   each pattern, is packed by the same kind of patterns greedily.
3. Pieces are ranked within their length (longest first, in salted buckets, so that one length may hold most of them)
   and take the places that the patterns have for their length, in order of rank.

Only the histogram, of SEQUENCE / UNIT rows, comes to the driver; only the patterns' places, bounded by the histogram as
well, are broadcast.

Defined results: a null text counts as empty; an empty text is one piece, its end mark. A document longer than a sequence
gives whole sequences and one shorter piece. Repeated rows are documents of their own. An empty table gives no pieces.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import cut_lineage, running_sum
from tessera.llm.words import give_back

SEQUENCE = 4096
#: Tokens by which lengths are told apart: the padding that this costs is UNIT / 2 a piece.
UNIT = 16
END_ID = 2
#: Pieces that are ranked together.
BUCKET = 1 << 12
#: Distinct words whose ids a task keeps at hand, in each of two generations.
MEMORY = 250_000

_SPECIAL = re.compile(r"<\|(?:start|end)oftext\|>", re.IGNORECASE)
_WORD_AND_MARKS = re.compile(r"([^\W\d_]+)([^\w\s']+)")

#: Byte-level models write each byte as one letter: printable ones as they are, the others in order from U+0100.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = dict(zip([b for b in range(256) if b not in _PRINTABLE], map(chr, range(256, 512))))


class WordTokenizer:
    """Token ids of whole texts by a tokenizer that lower-cases, drops white space and joins nothing across it.

    Such a tokenizer's ids for a text are those of its words in order, so that each distinct word is encoded once. Texts
    with a special token's string, or with a letter whose lower case depends on its neighbours, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        # Where words of letters go to the model as they are, byte by byte, the steps around it can be left out.
        self.direct = all(self._encode(w) == self._letters(w) for w in ("the", "straße", "übertriebenheit", "слово"))

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _word(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            composed = word.isascii() or unicodedata.is_normalized("NFC", word)
            parts = _WORD_AND_MARKS.fullmatch(word) if composed else None
            if parts:
                return self._known(parts[1]) + self._known(parts[2])
            found = self._letters(word) if self.direct and composed and word.isalpha() else self._encode(word)
        if len(self.new) >= MEMORY:
            self.old, self.new = self.new, {}
        self.new[word] = found
        return found

    def _known(self, word: str) -> bytes:
        found = self.new.get(word)
        return self._word(word) if found is None else found

    def forget(self) -> None:
        self.new, self.old = {}, {}

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if _SPECIAL.search(text) or "Σ" in text:
            return self._encode(text)
        words = text.lower().replace("\n", " ").split(" ")
        get = self.new.get
        return b"".join([get(w) or self._known(w) for w in words if w])


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) by piece. `path` is the tokenizer's file, found on every executor."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path or default_tokenizer()).ids
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                n = len(ids) // 4
                rows += [(k, at, min(sequence, n - at), zlib.crc32(ids[4 * at : 4 * (at + sequence)]), n) for at in range(0, n, sequence)]
            place, *rest = np.array(rows, dtype=np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place)), *map(pa.array, rest)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        tokenizer(path or default_tokenizer()).forget()
        give_back()

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return found.mapInArrow(run, f"doc_id {found.schema['id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long")


def _best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of most value within the capacity, by dynamic programming over filled units, and its value."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        fits = np.searchsorted(sizes, c, side="right")
        if fits:
            values = best[c - sizes[:fits]] + prices[:fits]
            k = int(np.argmax(values))
            if values[k] > best[c] + 1e-12:
                best[c], last[c] = values[k], k
    pattern, c = np.zeros(len(sizes), dtype=np.int64), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[last[c]] += 1
            c -= sizes[last[c]]
    return best[capacity], pattern


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """By elimination, a row at a time: the basis has some hundred rows, and threads of a linear algebra library are of no use beside the JVM."""
    n = len(matrix)
    both = np.hstack([matrix, np.eye(n)])
    for k in range(n):
        pivot = k + int(np.argmax(np.abs(both[k:, k])))
        both[[k, pivot]] = both[[pivot, k]]
        both[k] /= both[k, k]
        factors = both[:, k].copy()
        factors[k] = 0
        both -= factors[:, None] * both[k]
    return both[:, n:]


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-4) -> list[tuple[np.ndarray, int]]:
    """Patterns with how often each is used, so that every size (ascending, in units) is cut exactly as often as demanded.

    The linear program is solved within `gap` of its bound by the simplex method with generated columns.
    """
    m = len(sizes)
    if not m:
        return []
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1 / (capacity // sizes))
    x = inverse @ demand
    for step in range(50 * m):
        prices = inverse.sum(axis=0)
        value, pattern = _best_pattern(prices, sizes, capacity)
        if value <= 1 + 1e-9 or x.sum() <= (1 + gap) * (prices @ demand) / value:
            break
        d = inverse @ pattern
        ratios = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(np.argmin(ratios))
        basis[:, out] = pattern
        if step % 100 == 99:
            inverse = _inverse(basis)
        else:
            row = inverse[out] / d[out]
            inverse -= np.outer(d, row)
            inverse[out] = row
        x = np.maximum(inverse @ demand, 0)
    used = np.floor(x + 1e-6).astype(np.int64)
    left = demand - (basis.astype(np.int64) @ used)
    while (left < 0).any():  # only rounding in the arithmetic gets here
        k = int(np.argmax((basis[np.argmin(left)] > 0) * used))
        if not used[k] or not basis[np.argmin(left), k]:
            raise ArithmeticError("no used pattern holds a size that is cut too often")
        used[k] -= 1
        left = demand - (basis.astype(np.int64) @ used)
    found = [(basis[:, k].astype(np.int64), int(used[k])) for k in range(m) if used[k]]
    while left.any():
        pattern, room = np.zeros(m, dtype=np.int64), capacity
        for k in reversed(range(m)):
            fits = min(left[k], room // sizes[k])
            pattern[k], room = fits, room - fits * sizes[k]
        times = int(np.min(left[pattern > 0] // pattern[pattern > 0]))
        found.append((pattern, times))
        left = left - times * pattern
    return found


def pack(cut: DataFrame, sequence: int = SEQUENCE, unit: int = UNIT) -> DataFrame:
    """`cut`, as `pieces` makes it, with sequence_id and offset long."""
    spark = cut.sparkSession
    cut = cut_lineage(cut.withColumn("units", F.ceil(F.col("length") / unit).cast("int")))
    histogram = {r["units"]: r["n"] for r in cut.groupBy("units").agg(F.count("*").alias("n")).collect()}
    sizes = np.array(sorted(histogram), dtype=np.int64)
    patterns = cutting_stock(sizes, np.array([histogram[s] for s in sizes], dtype=np.int64), -(-sequence // unit))
    places, first, done = [], 0, dict.fromkeys(sizes.tolist(), 0)
    for pattern, times in patterns:
        for s, a in zip(sizes.tolist(), pattern.tolist()):
            if a:
                places.append((s, done[s], done[s] + a * times, a, first))
                done[s] += a * times
        first += times
    places = spark.createDataFrame(places, "units int, low long, high long, each long, first long")
    buckets = max(1, -(-sum(histogram.values()) // BUCKET))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    ranked = running_sum(salted, "units", "salt", [F.desc("length"), F.col("doc_id"), F.col("start"), F.col("ids_crc32")], F.lit(1))
    k = F.col("before") - F.col("low")
    found = ranked.join(F.broadcast(places), "units").where("before >= low and before < high")
    found = found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"), "units", "before")
    order = "partition by sequence_id order by units desc, before rows between unbounded preceding and 1 preceding"
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.expr(f"sum(length) over ({order})"), F.lit(0)).cast("long").alias("offset"))


def padded_length(filled: int, sequence: int = SEQUENCE) -> int:
    """A sequence's length: as filled if that is a power of two, else padded to the whole."""
    return filled if filled & (filled - 1) == 0 else sequence


def sequences(docs: DataFrame, packed: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, pad_id: int = 0, sequence: int = SEQUENCE) -> DataFrame:
    """(sequence_id, ids array<int>): the padded sequences that `packed` describes, for documents with distinct ids."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = tokenizer(path or default_tokenizer()).ids
        for batch in batches:
            ids = [np.frombuffer(run(t or "") + end, dtype="<u4")[s : s + n].astype(np.int32) for t, s, n in zip(*(batch.column(k).to_pylist() for k in (3, 2, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["sequence_id", "offset", "ids"])

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    joined = packed.join(texts, F.col("doc_id").eqNullSafe(F.col("_id"))).select("sequence_id", "offset", "start", "_text", "length")
    rows = joined.mapInArrow(encode, "sequence_id long, offset long, ids array<int>")
    whole = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"))
    n = F.size("ids")
    lacking = F.when(n.bitwiseAND(n - 1) == 0, F.lit(0)).otherwise(F.lit(sequence) - n)
    return whole.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), lacking)).alias("ids"))
