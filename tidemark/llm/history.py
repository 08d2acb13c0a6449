"""New batches against all history: Bloom filters by partition before a persistent store of fingerprints.

A store is a folder with one sub-folder per generation (the first build, then one per batch). Each generation has
three tables cut by ``part`` and sorted by the 64-bit key ``h``: ``keys`` (exact values), ``prints`` (winnowed
fingerprints of texts, each with the text's word marks) and ``docs`` (the texts), and a Bloom filter per table and
part. A batch is never joined with the history: its own keys go to the tasks of their parts, which ask the Bloom
filters and read of the store only the row groups that can hold the keys that pass. Texts that share a fingerprint grow
with the history, rewordings hardly do: word marks tell most of the former apart before any text is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.winnow import canonical, fingerprints, mix
from tidemark.session import new_folder

#: Bytes of a piece of text and pieces of a window; see ``winnow``.
GRAM, WINDOW = 28, 6
#: Share of the larger text's fingerprints that a light rewording keeps, and of the words in order.
COVERAGE, SAME_WORDS = 0.3, 0.86
#: Rows one part of the store should hold, and bits of its Bloom filter per row.
PART_ROWS, BLOOM_BITS, BLOOM_HASHES = 500_000, 16, 7
#: Slots of the table of fingerprint counts, which gives the order from rare to common.
COUNT_SLOTS = 1 << 20
#: Bits of a text's word marks, above the number of its words; greater numbers than ``MANY_WORDS`` are not told apart.
MARKS, MANY_WORDS = 56, 255
#: Bytes of a batch that ask one part together, and pairs made of them at a time.
ASKED_BYTES, PAIRS = 1 << 24, 500_000


def _positions(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    u = h.view(np.uint64)
    step = mix(u) | np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(BLOOM_HASHES):
            yield mix(u + np.uint64(i) * step) % np.uint64(bits)


def bloom_build(h: np.ndarray) -> bytes:
    bits = max(64, len(h) * BLOOM_BITS + 7 & ~7)
    marks = np.zeros(bits, bool)
    for at in _positions(h, bits):
        marks[at.astype(np.int64)] = True
    return np.packbits(marks).tobytes()


def bloom_test(bloom: bytes, h: np.ndarray) -> np.ndarray:
    marks = np.frombuffer(bloom, np.uint8)
    out = np.ones(len(h), bool)
    for at in _positions(h, len(marks) * 8):
        at = at.astype(np.int64)
        out &= (marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return out


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def _files(folder: str) -> list[tuple[pafs.FileSystem, str]]:
    fs, path = _fs(folder)
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True, recursive=True))
    return [(fs, f.path) for f in found if f.path.endswith(".parquet")]


@lru_cache(16)
def _bloom(folder: str) -> bytes | None:
    for fs, f in _files(folder):
        t = pq.read_table(f, filesystem=fs, columns=["bloom"])
        if t.num_rows:
            return t["bloom"][0].as_py()
    return None


@lru_cache(2)
def _counts(folder: str) -> np.ndarray:
    out = np.zeros(COUNT_SLOTS, np.int64)
    for fs, f in _files(folder):
        t = pq.read_table(f, filesystem=fs)
        np.add.at(out, t["slot"].to_numpy(), t["n"].to_numpy())
    return out


def rare_first(row: np.ndarray, h: np.ndarray, counts: np.ndarray, coverage: float) -> tuple[np.ndarray, np.ndarray]:
    """The rarest fingerprints of each row, as many as any text covering it must share one of."""
    n = np.bincount(row)
    order = np.lexsort((h, counts[(h & (COUNT_SLOTS - 1))], row))
    row, h = row[order], h[order]
    rank = np.arange(len(row)) - (np.cumsum(n) - n)[row]
    keep = rank < n[row] - np.ceil(coverage * n[row]) + 1
    return row[keep], h[keep]


def word_marks(texts: list[str]) -> np.ndarray:
    """A bit per word by its hash, and the number of words in the lowest byte."""
    bit: dict[str, int] = {}
    out = np.zeros(len(texts), np.uint64)
    for i, t in enumerate(texts):
        words, marks = t.split(), 0
        for w in words:
            b = bit.get(w)
            if b is None:
                b = bit[w] = 256 << crc32(w.encode()) % MARKS
            marks |= b
        out[i] = marks | min(len(words), MANY_WORDS)
    return out.view(np.int64)


def may_reword(a: np.ndarray, b: np.ndarray, same_words: float) -> np.ndarray:
    """Whether texts of these word marks can have ``same_words`` in order: a bit of one alone is a word the other lacks."""
    na, nb = a & 255, b & 255
    unlike = np.bitwise_count((a ^ b).view(np.uint64) >> np.uint64(8))
    return (unlike <= (1 - same_words) * (na + nb) + 1e-6) | (na == MANY_WORDS) | (nb == MANY_WORDS)


def _may_reword(a: str, b: str, same_words: float) -> Column:
    """``may_reword`` of two columns."""
    na, nb = F.col(a).bitwiseAND(F.lit(255)), F.col(b).bitwiseAND(F.lit(255))
    unlike = F.bit_count(F.shiftrightunsigned(F.col(a).bitwiseXOR(F.col(b)), 8))
    return (unlike <= F.lit(1 - same_words) * (na + nb) + F.lit(1e-6)) | (na == MANY_WORDS) | (nb == MANY_WORDS)


def reworded(a: str, b: str, fa: np.ndarray, fb: np.ndarray, coverage: float, same_words: float) -> bool:
    """Shared coverage first, then the words in order."""
    if a == b:
        return True
    if len(np.intersect1d(fa, fb, assume_unique=True)) < coverage * max(len(fa), len(fb)):
        return False
    m = SequenceMatcher(None, a.split(), b.split(), autojunk=False)
    return m.quick_ratio() >= same_words and m.ratio() >= same_words


def _verify(left: list[str], right: list[str], coverage: float, same_words: float) -> np.ndarray:
    texts = list(dict.fromkeys(left + right))
    row, h = fingerprints(texts, GRAM, WINDOW)
    at = np.searchsorted(row, np.arange(len(texts) + 1))
    prints = {t: h[at[i] : at[i + 1]] for i, t in enumerate(texts)}
    return np.array([reworded(a, b, prints[a], prints[b], coverage, same_words) for a, b in zip(left, right)], bool)


@dataclass
class History:
    """A persistent store of accepted records; ``check`` decides a batch and adds what was accepted."""

    spark: SparkSession
    path: str
    parts: int
    generations: list[str] = field(default_factory=list)
    coverage: float = COVERAGE
    same_words: float = SAME_WORDS

    # --- writing

    def _write(self, df: DataFrame, gen: str, name: str) -> None:
        """A table of the generation by part, sorted by key, and the Bloom filter of each part."""
        folder = f"{self.path}/{gen}/{name}"
        (df.withColumn("part", F.pmod("h", F.lit(self.parts)).cast("int")).repartition("part").sortWithinPartitions("part", "h").write.partitionBy("part").parquet(folder))

        if name == "docs":
            return  # asked only for documents that are there

        def blooms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in (p for b in batches for p in b["id"].to_pylist()):
                found = [pq.read_table(f, filesystem=fs, columns=["h"])["h"].to_numpy() for fs, f in _files(f"{folder}/part={part}")]
                if found:
                    bits = bloom_build(np.unique(np.concatenate(found)))
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([bits], pa.binary())], names=["part", "bloom"])

        # each part is read where it lies: nothing is shuffled for its filter
        self.spark.range(0, self.parts, 1, self.parts).mapInArrow(blooms, "part int, bloom binary").write.partitionBy("part").parquet(f"{self.path}/{gen}/bloom-{name}")

    def add(self, gen: str, keys: DataFrame | None, texts: DataFrame) -> None:
        """``keys`` (kind, value) and canonical ``texts`` (text) become the next generation; texts are keys too."""
        self._write(texts.where("text is not null").select("text").distinct().select(F.xxhash64("text").alias("h"), "text"), gen, "docs")
        docs = self.spark.read.schema("h bigint, text string").parquet(f"{self.path}/{gen}/docs")  # made once, read by all that follows
        if not self.generations:
            self._first_counts(docs.select("text"))
        hashed = hash_keys(docs.select(F.lit("text").alias("kind"), F.col("text").alias("value")))
        if keys is not None:
            hashed = hashed.unionByName(hash_keys(keys.where("value is not null")).distinct())
        prints = self._prints(docs.select(F.col("h").alias("id"), "text")).select("h", F.col("id").alias("doc"), "marks")
        with ThreadPoolExecutor(2) as pool:
            list(pool.map(self._write, (hashed, prints), (gen,) * 2, ("keys", "prints")))
        self.generations.append(gen)

    def _first_counts(self, texts: DataFrame) -> None:
        def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(COUNT_SLOTS, np.int64)
            for b in batches:
                _, h = fingerprints(b["text"].to_pylist(), GRAM, WINDOW)
                np.add.at(n, h & (COUNT_SLOTS - 1), 1)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["slot", "n"])

        texts.mapInArrow(slots, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).coalesce(1).write.parquet(f"{self.path}/counts")

    def _prints(self, texts: DataFrame) -> DataFrame:
        """``(id, h, marks)``: the rare fingerprints of each ``(id, text)``, with its word marks."""
        folder, coverage = f"{self.path}/counts", self.coverage

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b["text"].to_pylist()
                row, h = rare_first(*fingerprints(texts, GRAM, WINDOW), _counts(folder), coverage)
                yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(row)), pa.array(h), pa.array(word_marks(texts)[row])], names=["id", "h", "marks"])

        return texts.select("id", "text").mapInArrow(run, "id bigint, h bigint, marks bigint")

    # --- reading

    def _probe(self, df: DataFrame, name: str, schema: str, emit: Callable[[pa.RecordBatch, pa.Table], pa.RecordBatch | None]) -> DataFrame:
        """Rows of ``df`` (with ``h``) beside the store's rows of equal ``h``; ``emit`` makes the output of the two."""
        gens = [f"{self.path}/{g}" for g in self.generations]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for p, b in _by_part(batches):
                h = b["h"].to_numpy()
                for g in gens:
                    bloom = _bloom(f"{g}/bloom-{name}/part={p}") if name != "docs" else None
                    at = np.arange(len(h)) if name == "docs" else np.flatnonzero(bloom_test(bloom, h)) if bloom else ()
                    if not len(at):
                        continue
                    wanted = pa.array(np.unique(h[at]))
                    kept = [pq.ParquetFile(f, filesystem=fs) for fs, f in _files(f"{g}/{name}/part={p}")]
                    found = [t for f in kept for t in _row_groups(f, wanted)]
                    if not found:
                        continue
                    rows = pa.concat_tables(found)
                    rows = rows.take(pc.sort_indices(rows["h"]))
                    sh = rows["h"].to_numpy()
                    lo, n = np.searchsorted(sh, h[at], "left"), np.searchsorted(sh, h[at], "right")
                    n -= lo
                    at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
                    if not len(at):
                        continue
                    slot = np.cumsum(n) // PAIRS
                    for own in np.split(np.arange(len(at)), np.flatnonzero(slot[1:] != slot[:-1]) + 1):
                        k = n[own]
                        right = np.repeat(lo[own] - (np.cumsum(k) - k), k) + np.arange(k.sum())
                        out = emit(b.take(pa.array(np.repeat(at[own], k))), rows.take(pa.array(right)))
                        if out is not None and out.num_rows:
                            yield out

        keyed = df.withColumn("part", F.pmod("h", F.lit(self.parts)).cast("int"))
        return keyed.hint("rebalance", "part").sortWithinPartitions("part").mapInArrow(run, schema)

    def known_keys(self, keys: DataFrame) -> DataFrame:
        """``(id)`` of the rows of ``keys`` (id, kind, value) whose value the store has."""

        def emit(mine: pa.RecordBatch, theirs: pa.Table) -> pa.RecordBatch:
            same = pc.equal(mine["h2"], theirs["h2"].combine_chunks())
            return pa.RecordBatch.from_arrays([mine["id"].filter(same)], names=["id"])

        return self._probe(hash_keys(keys.where("value is not null"), "id"), "keys", "id bigint", emit).distinct()

    def known_texts(self, texts: DataFrame, prints: DataFrame) -> DataFrame:
        """``(id)`` of the texts that lightly reword a text of the store."""
        coverage, same_words = self.coverage, self.same_words

        def candidates(mine: pa.RecordBatch, theirs: pa.Table) -> pa.RecordBatch:
            near = pa.array(may_reword(mine["marks"].to_numpy(), theirs["marks"].to_numpy(), same_words))
            t = pa.table({"id": mine["id"].filter(near), "h": theirs["doc"].filter(near)}).group_by(["id", "h"]).aggregate([])
            return next(iter(t.select(["id", "h"]).combine_chunks().to_batches()), None)

        def verified(mine: pa.RecordBatch, theirs: pa.Table) -> pa.RecordBatch:
            ok = _verify(mine["text"].to_pylist(), theirs["text"].to_pylist(), coverage, same_words)
            return pa.RecordBatch.from_arrays([mine["id"].filter(pa.array(ok))], names=["id"])

        near = self._probe(prints, "prints", "id bigint, h bigint", candidates).distinct()
        return self._probe(near.join(texts, "id"), "docs", "id bigint", verified).distinct()

    def near_in_batch(self, texts: DataFrame, prints: DataFrame) -> DataFrame:
        """``(a, b)``, a < b: texts of one batch of which one lightly rewords the other."""
        coverage, same_words = self.coverage, self.same_words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                ok = pa.array(_verify(x["ta"].to_pylist(), x["tb"].to_pylist(), coverage, same_words))
                yield pa.RecordBatch.from_arrays([x["a"].filter(ok), x["b"].filter(ok)], names=["a", "b"])

        left, right = prints.select("h", F.col("id").alias("a"), F.col("marks").alias("ma")), prints.select("h", F.col("id").alias("b"), F.col("marks").alias("mb"))
        pairs = left.join(right, "h").where(F.expr("a < b") & _may_reword("ma", "mb", same_words)).select("a", "b").distinct()
        pairs = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        return pairs.mapInArrow(run, "a bigint, b bigint")

    def check(self, batch: DataFrame, gen: str, keys: list[tuple[str, Column]], record_id: str, text: str) -> DataFrame:
        """``(id, reason)`` of the rows of ``batch`` to refuse; what is accepted joins the store as generation ``gen``.

        ``reason`` is ``known_key`` (a value of ``keys`` is in the store), ``same_text`` (equal but for formatting to
        an earlier row of the batch that no store entry refuses), ``known_text`` (rewords a text of the store) or
        ``near_text`` (rewords an accepted earlier row of the batch). A null key or a text without letters and digits
        matches nothing; such rows are accepted and add no text. Other columns are not looked at.
        """
        base = f"{self.path}/{gen}"
        rows = self._kept(batch.select(F.col(record_id).cast("bigint").alias("id"), canonical(F.col(text)).alias("text"), *[c.alias(f"k{i}") for i, (_, c) in enumerate(keys)]), f"{base}/rows")
        tagged = [F.struct(F.lit(k).alias("kind"), F.col(f"k{i}").alias("value")) for i, (k, _) in enumerate(keys)] + [F.struct(F.lit("text").alias("kind"), F.col("text").alias("value"))]
        by_key = self._kept(self.known_keys(rows.select("id", F.inline(F.array(*tagged)))).select("id", F.lit("known_key").alias("reason")), f"{base}/by-key")
        open_rows = rows.where("text is not null").select("id", "text").join(by_key, "id", "left_anti")
        first = self._kept(open_rows.groupBy("text").agg(F.min("id").alias("id")), f"{base}/first")
        copies = open_rows.join(first, "id", "left_anti").select("id", F.lit("same_text").alias("reason"))
        prints = self._kept(self._prints(first), f"{base}/own-prints")
        by_text = self._kept(self.known_texts(first, prints).select("id", F.lit("known_text").alias("reason")), f"{base}/by-text")
        left = first.join(by_text, "id", "left_anti")
        edges = self._kept(self.near_in_batch(left, prints.join(by_text, "id", "left_anti")), f"{base}/edges")
        refused, n = None, 0
        while not edges.isEmpty():  # earlier rows first: those that no open row precedes are accepted, their neighbours refused
            live = edges if refused is None else edges.join(refused.select(F.col("id").alias("a")), "a", "left_anti").join(refused.select(F.col("id").alias("b")), "b", "left_anti")
            sources = live.select("a").distinct().join(live.select(F.col("b").alias("a")), "a", "left_anti")
            new = self._kept(live.join(sources, "a").select(F.col("b").alias("id")).distinct(), f"{base}/near-{n}")
            refused, n = new if refused is None else refused.unionByName(new), n + 1
            edges = self._kept(live.join(new.select(F.col("id").alias("b")), "b", "left_anti").join(sources, "a", "left_anti").select("a", "b"), f"{base}/edges-{n}")
        out = by_key.unionByName(copies).unionByName(by_text)
        if refused is not None:
            out = out.unionByName(refused.select("id", F.lit("near_text").alias("reason")))
            left = left.join(refused, "id", "left_anti")
        decided = self._kept(out, f"{base}/refused")
        self.add(gen, None, left)
        return decided

    def _kept(self, df: DataFrame, folder: str) -> DataFrame:
        df.write.parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows sorted by part, those of one part together, so that its files are read once and not once a batch."""
    held, part, size = [], None, 0
    for b in batches:
        parts = b["part"].to_numpy()
        for at in np.split(np.arange(len(parts)), np.flatnonzero(parts[1:] != parts[:-1]) + 1):
            if not len(at):
                continue
            if held and (parts[at[0]] != part or size >= ASKED_BYTES):
                yield part, pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            part = int(parts[at[0]])
            held.append(b.slice(at[0], len(at)))
            size += held[-1].nbytes
    if held:
        yield part, pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _row_groups(f: pq.ParquetFile, wanted: pa.Array) -> Iterator[pa.Table]:
    """Rows with a wanted key, from the row groups whose range of keys holds one."""
    w = wanted.to_numpy()
    at = next(i for i in range(f.metadata.num_columns) if f.metadata.schema.column(i).name == "h")
    for g in range(f.metadata.num_row_groups):
        s = f.metadata.row_group(g).column(at).statistics
        if s is None or not s.has_min_max or np.searchsorted(w, s.min, "left") < np.searchsorted(w, s.max, "right"):
            t = f.read_row_group(g)
            t = t.filter(pc.is_in(t["h"], value_set=wanted))
            if t.num_rows:
                yield t


def hash_keys(keys: DataFrame, *kept: str) -> DataFrame:
    """Two 64-bit hashes of kind and value: one finds the part and the row, the other confirms it."""
    return keys.select(*kept, F.xxhash64("kind", "value").alias("h"), F.xxhash64("value", "kind").alias("h2"))


def new_history(spark: SparkSession, rows: int) -> History:
    """An empty store in the shared folder, cut for about ``rows`` rows."""
    return History(spark, new_folder(spark, "history"), max(8, _parts(rows)))


def _parts(rows: int) -> int:
    return -(-rows // PART_ROWS)
