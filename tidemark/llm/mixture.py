"""Groups of rows that state the same thing in different words: Gaussian mixtures within blocks of one subject.

1. Word statistics over all rows: how often a word stands with a capital and without, and alone of its kind.
2. A row's subject is its most telling name (a word mostly written with a capital, first words aside, that most often
   stands alone of its kind in its row), or, without names, its rarest word. Rows of one model and subject form a block; a block of more rows
   than ``PIECE_ROWS`` is cut into pieces by the hash of the id.
3. Words weigh by rarity times how far rows of one block agree on them beyond chance, so the phrases that any
   subject is told in weigh nothing.
4. Rows become ``DIMS`` standardised features (signed random projection of the weighted words). In each piece a
   Gaussian mixture is fitted by expectation-maximisation with a regularised common covariance; the Bayesian
   information criterion chooses the number of components; the row of highest density stands for its component.
5. An exact check on the words themselves follows: a row stays with its component's representative if their weighted
   words overlap enough, and components whose representatives overlap are one group.
6. The representatives of the pieces of a large block go through 4 and 5 again, ``FAN`` pieces at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import written

#: Slots of the tables of word statistics: a fixed bound on what is sent to the tasks.
SLOTS = 1 << 20
DIMS = 64
PIECE_ROWS, FAN = 256, 4
#: Least overlap of weighted words with the representative.
OVERLAP = 0.3
#: Least variance of a standardised feature within a component, and steps of EM.
LEAST_VARIANCE, EM_STEPS = 0.15, 8
_WORD = r"[\p{L}\p{N}][\p{L}\p{N}'’-]*"
_MEMBERS = "block bigint, pieces int, piece int, id bigint, subject int, words array<int>"
_LABELS = _MEMBERS + ", label bigint, density double"


def _lists(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of every element of a list array."""
    off = a.offsets.to_numpy()
    flat = a.values.slice(off[0], off[-1] - off[0]).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(a)), np.diff(off)), flat


def _table(df: DataFrame, key: str, *values: str) -> list[np.ndarray]:
    """Sums per slot as dense arrays; at most ``SLOTS`` rows come to the driver."""
    t = df.groupBy(key).agg(*[F.sum(v).alias(v) for v in values]).toArrow()
    out = []
    for v in values:
        x = np.zeros(SLOTS)
        x[t[key].to_numpy()] = t[v].to_numpy()
        out.append(x)
    return out



def _groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole pieces from batches sorted by block and piece."""
    rest: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        key = np.stack([t["block"].to_numpy(), t["piece"].to_numpy().astype(np.int64)])
        new = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        same = rest and rest[-1]["block"][-1] == t["block"][0] and rest[-1]["piece"][-1] == t["piece"][0]
        cuts = [0, *new.tolist(), len(t)]
        for i, (x, y) in enumerate(zip(cuts, cuts[1:])):
            if i == 0 and not same and rest:
                yield pa.concat_tables(rest)
                rest = []
            elif i > 0:
                yield pa.concat_tables(rest)
                rest = []
            rest.append(t.slice(x, y - x))
    if rest:
        yield pa.concat_tables(rest)


def _words_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return _lists(t["words"].combine_chunks())


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word: ordered pairs of different tellings of one piece that share it, and pairs whose first has it."""
    both, first = np.zeros(SLOTS), np.zeros(SLOTS)
    for t in _groups_of(batches):
        row, w = _words_of(t)
        if len(t) < 2 or not len(w):
            continue
        told = np.zeros(len(t), np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(told, row, (w.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ** np.uint64(2))
        _, one = np.unique(told, return_index=True)
        keep = np.isin(row, one)
        slot, c = np.unique(w[keep], return_counts=True)
        both[slot] += c * (c - 1.0)
        first[slot] += c * (len(one) - 1.0)
    at = np.flatnonzero(first)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(both[at]), pa.array(first[at])], names=["slot", "both", "first"])


def fit(x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component and density of every row of many small samples at once; ``x`` is (sample, row, feature).

    Components are added one by one, each starting at the row farthest from all means, until the information
    criterion no longer falls. The covariance is common to the components, spherical, and never below
    ``LEAST_VARIANCE``.
    """
    b, n, d = x.shape
    count = mask.sum(1)
    label, density, best = np.zeros((b, n), int), np.zeros((b, n)), np.full(b, np.inf)
    live = np.arange(b)
    means = (x * mask[..., None]).sum(1, keepdims=True) / np.maximum(count, 1)[:, None, None]
    k = 1
    while len(live):
        xs, ms, ns = x[live], mask[live], count[live]
        share = np.full((len(live), k), 1.0 / k)
        var = np.full(len(live), LEAST_VARIANCE)
        square = (xs**2).sum(2)
        for _ in range(EM_STEPS if k > 1 else 1):
            dist = np.maximum(square[:, :, None] - 2 * np.einsum("bnd,bkd->bnk", xs, means) + (means**2).sum(2)[:, None, :], 0)
            logp = np.log(share)[:, None, :] - dist / (2 * var[:, None, None])
            top = logp.max(2, keepdims=True)
            r = np.exp(logp - top)
            r = r / r.sum(2, keepdims=True) * ms[..., None]
            mass = r.sum(1)
            means = np.einsum("bnk,bnd->bkd", r, xs) / np.maximum(mass, 1e-9)[..., None]
            share = np.maximum(mass / ns[:, None], 1e-9)
            var = np.maximum((r * dist).sum((1, 2)) / (ns * d), LEAST_VARIANCE)
        dist = np.maximum(square[:, :, None] - 2 * np.einsum("bnd,bkd->bnk", xs, means) + (means**2).sum(2)[:, None, :], 0)
        logp = np.log(share)[:, None, :] - dist / (2 * var[:, None, None]) - d / 2 * np.log(2 * np.pi * var)[:, None, None]
        top = logp.max(2)
        dens = top + np.log(np.exp(logp - top[..., None]).sum(2))
        bic = -2 * (dens * ms).sum(1) + (k * d + k) * np.log(np.maximum(ns, 2))
        better = bic < best[live]
        won = live[better]
        label[won], density[won], best[won] = logp[better].argmax(2), dens[better], bic[better]
        go = better & (ns > k)
        far = np.where(ms, dist.min(2), -1.0).argmax(1)
        means = np.concatenate([means, xs[np.arange(len(live)), far][:, None, :]], 1)[go]
        live, k = live[go], k + 1
    return label, density


def _settle(t: pa.Table, label: np.ndarray, density: np.ndarray, weight: np.ndarray, overlap: float) -> np.ndarray:
    """The row number that stands for each row's group after the exact check."""
    n = len(t)
    row, w = _words_of(t)
    slot, at = np.unique(w, return_inverse=True)
    has = np.zeros((n, len(slot)), np.float32)
    has[row, at] = 1.0
    w2 = (weight[slot] ** 2).astype(np.float32)
    w2[slot == t["subject"][0].as_py()] = 1e-3  # all have it
    shared = (has * w2) @ has.T
    own = np.diag(shared)
    like = shared >= overlap * (own[:, None] + own[None, :] - shared) - 1e-9
    like &= (own > 0)[:, None] & (own > 0)[None, :]
    np.fill_diagonal(like, True)
    order = np.lexsort((np.arange(n), -density))
    head = np.full(n, -1)
    heads: dict[int, int] = {}
    for i in order:  # the densest row of a component stands for it
        head[i] = heads.setdefault(int(label[i]), int(i))
    head = np.where(like[np.arange(n), head], head, -1)
    reps = [*heads.values(), *np.flatnonzero(head < 0).tolist()]
    head[head < 0] = np.flatnonzero(head < 0)
    root = {r: r for r in reps}

    def find(r: int) -> int:
        while root[r] != r:
            root[r] = r = root[root[r]]
        return r

    for i, a in enumerate(reps):
        for c in np.flatnonzero(like[a, reps[:i]]) if i else ():
            x, y = find(a), find(reps[c])
            if x != y:
                keep, gone = sorted((x, y), key=lambda r: (-density[r], r))
                root[gone] = keep
    return np.array([find(int(h)) for h in head])


def _mixtures(weight: np.ndarray, scale: np.ndarray, overlap: float) -> Callable:
    def project(t: pa.Table) -> np.ndarray:
        row, w = _words_of(t)
        h = (w.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        dim = (h >> np.uint64(40)) % np.uint64(DIMS)
        sign = np.where(h >> np.uint64(39) & np.uint64(1), 1.0, -1.0)
        x = np.zeros((len(t), DIMS))
        np.add.at(x, (row, dim.astype(int)), sign * weight[w])
        return x / scale

    def labelled(waiting: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        width = max(map(len, waiting))
        x, mask = np.zeros((len(waiting), width, DIMS)), np.zeros((len(waiting), width), bool)
        for i, t in enumerate(waiting):
            x[i, : len(t)], mask[i, : len(t)] = project(t), True
        label, density = fit(x, mask)
        out = []
        for i, t in enumerate(waiting):
            head = _settle(t, label[i, : len(t)], density[i, : len(t)], weight, overlap)
            out.append(t.append_column("label", t["id"].take(pa.array(head))).append_column("density", pa.array(density[i, : len(t)])))
        yield from pa.concat_tables(out).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[pa.Table]] = {}
        for t in _groups_of(batches):
            size = 1 << (len(t) - 1).bit_length()  # pieces of like size are fitted together
            waiting.setdefault(size, []).append(t)
            if len(waiting[size]) * size >= 8192:
                yield from labelled(waiting.pop(size))
        for some in waiting.values():
            yield from labelled(some)

    return run


def same_meaning(df: DataFrame, *, record_id: str, text: str, model: str, left_out: Column, piece_rows: int = PIECE_ROWS, overlap: float = OVERLAP) -> DataFrame:
    """``(id, group_id, density)`` of every row with a text and a model that ``left_out`` is not true of.

    ``group_id`` is the id of the group's representative, its row of highest density; rows alone in their group are
    there too, with their own id. Empty texts, texts without words, null models and null ids have no group. Equal
    texts fall into one group; of equal densities the smaller id is the representative. Other columns are not read.
    """
    words = F.array_distinct(F.regexp_extract_all(F.col(text).cast("string"), F.lit(_WORD), F.lit(0)))
    rows = df.where(F.col(model).isNotNull() & F.col(text).isNotNull() & F.col(record_id).isNotNull() & ~F.coalesce(left_out, F.lit(False)))
    rows = rows.select(F.col(record_id).cast("bigint").alias("id"), F.xxhash64(F.col(model)).alias("model"), words.alias("w")).where(F.size("w") > 0)
    slot = lambda w: F.pmod(F.xxhash64(F.lower(w)), F.lit(SLOTS)).cast("int")
    capital = lambda w, i: F.when(~F.regexp_like(w, F.lit(r"^\p{Lu}\p{Ll}{2}")), 0).when(i == 0, 2).otherwise(1)  # noqa: E731  # 2: the first word has a capital anyway
    rows = rows.select("id", "model", F.transform("w", slot).alias("words"), F.transform("w", capital).alias("caps"))
    base = written(rows, "mixture-words")
    sc = df.sparkSession.sparkContext

    each = base.select(F.explode(F.arrays_zip("words", "caps")).alias("x")).select(F.col("x.words").alias("slot"), (F.col("x.caps") == 1).cast("bigint").alias("cap"), (F.col("x.caps") == 0).cast("bigint").alias("low"), F.lit(1).alias("all"))
    cap, low, seen = _table(each, "slot", "cap", "low", "all")
    more_caps, used, seen = cap > low, seen > 0, np.maximum(seen, 1)
    total = max(1.0, float(base.count()))
    b_caps = sc.broadcast(more_caps)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, w = _lists(b["words"])
            name = (_lists(b["caps"])[1] > 0) & b_caps.value[w]
            row, w = row[name], w[name]
            sole = (np.bincount(row, minlength=len(b))[row] == 1).astype(float)
            u, at = np.unique(w, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(np.bincount(at, sole, len(u))), pa.array(np.bincount(at, minlength=len(u)).astype(float))], names=["slot", "sole", "any"])

    sole, any_ = _table(base.mapInArrow(alone, "slot bigint, sole double, any double"), "slot", "sole", "any")
    telling = (sole + 0.5) / np.maximum(any_, 1)
    b_subject = sc.broadcast((telling, any_, seen))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        telling, any_, seen = b_subject.value
        for b in batches:
            row, w = _lists(b["words"])
            name = (_lists(b["caps"])[1] > 0) & b_caps.value[w]
            score = np.where(name, 1.0 + telling[w], 1.0 / (1.0 + seen[w]))
            order = np.lexsort((w, -score, row))
            first = order[np.searchsorted(row[order], np.arange(len(b)))]
            key, many = w[first].astype(np.int64), np.where(name[first], any_[w[first]], seen[w[first]])
            pieces = np.maximum(1, np.ceil(many / piece_rows)).astype(np.int32)
            ids = b["id"].to_numpy()
            with np.errstate(over="ignore"):
                spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64)
                block = b["model"].to_numpy() * np.int64(1_000_003) + key
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(pieces), pa.array((spread % pieces).astype(np.int32)), b["id"], pa.array(key.astype(np.int32)), b["words"]], names=["block", "pieces", "piece", "id", "subject", "words"])

    members = written(base.mapInArrow(blocks, _MEMBERS), "mixture-members")
    together = lambda x: x.repartition("block", "piece").sortWithinPartitions("block", "piece", "id")
    both, first = _table(together(members).mapInArrow(_agreement, "slot bigint, both double, first double"), "slot", "both", "first")
    chance = np.minimum(seen / total, 1.0)
    agree = np.clip((both / np.maximum(first, 1) - chance) / np.maximum(1 - chance, 1e-9), 0, 1)
    agree = (agree * first + 0.5 * 8) / (first + 8) * (first > 0) + 0.5 * (first == 0)
    weight = np.log(total / np.minimum(seen, total)) * agree
    dims = ((np.arange(SLOTS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(DIMS)
    scale = np.sqrt(np.maximum(np.bincount(dims[used].astype(int), (weight**2 * chance * (1 - chance))[used], DIMS), 1e-6))
    b_weights = sc.broadcast((weight, scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _mixtures(*b_weights.value, overlap)(batches)

    labels = written(together(members).mapInArrow(run, _LABELS), "mixture-labels-0")
    out, heads, n = labels.select("id", "label", "density"), labels.where("pieces > 1 and id = label"), 0
    most = int(np.ceil(max(any_.max(initial=1), seen.max(initial=1)) / piece_rows))
    while most > 1 and not heads.isEmpty():
        n, most = n + 1, -(-most // FAN)
        heads = heads.select("block", F.ceil(F.col("pieces") / FAN).cast("int").alias("pieces"), (F.col("piece") / FAN).cast("int").alias("piece"), "id", "subject", "words")
        merged = written(together(heads).mapInArrow(run, _LABELS), f"mixture-labels-{n}")
        out = out.join(merged.select(F.col("id").alias("label"), F.col("label").alias("higher")), "label", "left").select("id", F.coalesce("higher", "label").alias("label"), "density")
        heads = merged.where("pieces > 1 and id = label")
    return out.select("id", F.col("label").alias("group_id"), "density")
