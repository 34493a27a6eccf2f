"""Benchmark decontamination by a prefix-filtered join of shingles.

A benchmark item's windows are the sets that documents may contain. Each window is indexed by its
rarest shingle alone (the necessary prefix, as containment asks for all of them), rarity being
counted over all documents. Where a document has that shingle, its place in the window gives the
only start at which the window can be; the document must reach from there to the window's end,
and then the words are compared.

A benchmark of one block is broadcast with its index. A larger one is joined: a table of fixed size
has the counts, each window goes to its rarest shingle's hash, and so do the places of that hash in
the documents with the words around them, which is all that a comparison needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

WINDOW = 10
SHINGLE = 3
#: Bound on the benchmark text that is broadcast; more is joined by a shuffle.
BLOCK_BYTES = 8 << 20
#: Candidate windows of a text that are compared at once.
CANDIDATES = 1 << 16
#: In the join a bitmap of 2 to this many bits tells which hashes matter, and a table of 2 to this many slots has the
#: counts. What shares a bit or a slot adds to the work, never to the result.
BITS, SLOTS = 27, 22
#: The commonest HOT of the hashes with more than PLACES places are dealt to several tasks.
PLACES, HOT = 50_000, 100_000
#: Fixed value: ASCII but letters and digits separates words.
SEPARATORS = bytes(32 if chr(b) not in "0123456789abcdefghijklmnopqrstuvwxyz" and b < 128 else b for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Only A-Z is lower-cased; a null text has no words."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(SEPARATORS).split()


@dataclass
class Index:
    """Distinct windows of some items, their words numbered by vocabulary.

    windows[n] are those of n words, items[n] the ids of the items that have them; shingles[k] are
    the sorted keys of all shingles of k words; after choose(), prefix[k] are those that index a
    window, and ends[k], own[k] list their (n, number of the window, place of the shingle).
    """

    vocabulary: dict[bytes, int]
    windows: dict[int, np.ndarray]
    items: dict[int, list[list[str]]]
    shingles: dict[int, np.ndarray]
    prefix: dict[int, np.ndarray] | None = None
    ends: dict[int, np.ndarray] | None = None
    own: dict[int, np.ndarray] | None = None

    @staticmethod
    def of(rows: list[tuple[str, str | None]]) -> Index:
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in rows:
            ids = tuple(vocabulary.setdefault(w, len(vocabulary)) for w in words(text))
            n = min(WINDOW, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                found.setdefault(ids[i : i + n], set()).add(item)
        by: dict[int, list[tuple[int, ...]]] = {}
        for x in sorted(found):
            by.setdefault(len(x), []).append(x)
        index = Index(vocabulary, {n: np.array(x, np.int64) for n, x in by.items()}, {n: [sorted(found[w]) for w in x] for n, x in by.items()}, {})
        for n, x in index.windows.items():
            k = min(SHINGLE, n)
            index.shingles[k] = np.union1d(index.shingles.get(k, np.zeros(0, np.int64)), index.keys(x, k))
        return index

    def keys(self, windows: np.ndarray, k: int) -> np.ndarray:
        """The keys of the shingles of k words, one column for each place in the windows."""
        m = windows.shape[1] - k + 1
        out = np.zeros((len(windows), m), np.int64)
        for i in range(k):
            out = out * len(self.vocabulary) + windows[:, i : i + m]
        return out

    def numbered(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in words(text)], np.int64)

    def places(self, ids: np.ndarray, k: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, number in among) of each shingle of k words that is in among."""
        m = len(ids) - k + 1
        if m <= 0 or not len(among):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = ids >= 0
        fits = known[:m].copy()
        for i in range(1, k):
            fits &= known[i : i + m]
        at = np.flatnonzero(fits)
        key = np.zeros(len(at), np.int64)
        for i in range(k):
            key = key * len(self.vocabulary) + ids[at + i]
        number = np.minimum(np.searchsorted(among, key), len(among) - 1)
        same = among[number] == key
        return at[same], number[same]

    def choose(self, counts: dict[int, np.ndarray]) -> None:
        """Index each window by its rarest shingle; the first of equals."""
        own: dict[int, list[np.ndarray]] = {k: [] for k in self.shingles}
        for n, x in self.windows.items():
            k = min(SHINGLE, n)
            number = np.searchsorted(self.shingles[k], self.keys(x, k))
            place = counts[k][number].argmin(1)
            each = np.arange(len(x))
            own[k].append(np.column_stack([number[each, place], np.full(len(x), n), each, place]))
        self.prefix, self.ends, self.own = {}, {}, {}
        for k, parts in own.items():
            rows = np.concatenate(parts)
            rows = rows[np.argsort(rows[:, 0], kind="stable")]
            used, starts = np.unique(rows[:, 0], return_index=True)
            self.prefix[k], self.ends[k], self.own[k] = self.shingles[k][used], np.r_[starts, len(rows)], rows[:, 1:]

    def hits(self, text: str | None) -> tuple[int, list[int], list[int], list[str]]:
        """(number of words, starts and ends of the windows found, ids of their items)."""
        ids = self.numbered(text)
        starts, ends, items = [], [], set()
        for k, prefix in self.prefix.items():
            at, number = self.places(ids, k, prefix)
            first, last = self.ends[k][number], self.ends[k][number + 1]
            before = np.concatenate([[0], np.cumsum(last - first)])
            for lo in range(0, int(before[-1]), CANDIDATES):
                each = np.arange(lo, min(lo + CANDIDATES, int(before[-1])))
                row = np.searchsorted(before, each, "right") - 1
                n, j, place = self.own[k][each - before[row] + first[row]].T
                start = at[row] - place
                for size in np.unique(n):
                    fits = (n == size) & (start >= 0) & (start + size <= len(ids))
                    s, w = start[fits], j[fits]
                    same = (ids[s[:, None] + np.arange(size)] == self.windows[size][w]).all(1)
                    starts += s[same].tolist()
                    ends += (s[same] + size).tolist()
                    for x in np.unique(w[same]):
                        items.update(self.items[size][x])
        return len(ids), starts, ends, sorted(items)


def covered(starts: list[int], ends: list[int]) -> int:
    """The number of places inside one or more of the spans."""
    n, reach = 0, 0
    for a, b in sorted(zip(starts, ends, strict=True)):
        n += max(0, b - max(a, reach))
        reach = max(reach, b)
    return n


def counted(docs: DataFrame, index: Index) -> None:
    """Count the index's shingles over all documents and choose the windows' prefixes."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        sums = {k: np.zeros(len(x), np.int64) for k, x in own.shingles.items()}
        for frame in frames:
            for text in frame["text"]:
                ids = own.numbered(text)
                for k, x in own.shingles.items():
                    np.add.at(sums[k], own.places(ids, k, x)[1], 1)
        for k, x in sums.items():
            at = np.flatnonzero(x)
            yield pd.DataFrame({"k": np.full(len(at), k), "number": at, "n": x[at]})

    got = docs.select("text").mapInPandas(run, "k int, number long, n long").groupBy("k", "number").agg(F.sum("n").alias("n")).toPandas()
    counts = {k: np.zeros(len(x), np.int64) for k, x in index.shingles.items()}
    for k, own in got.groupby("k"):
        counts[k][own["number"]] = own["n"]
    index.choose(counts)
    shared.unpersist()


def known(benchmark: DataFrame) -> DataFrame:
    """(item, text) of the items with a text."""
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where("text is not null")


def index_of(docs: DataFrame, items: DataFrame, block_bytes: int) -> Index | None:
    """The Index of items of at most block_bytes of text, rarity counted over all documents; None for more."""
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > block_bytes:
        return None
    index = Index.of([(r["item"], r["text"]) for r in items.collect()])
    if index.windows:
        counted(docs, index)
    else:
        index.prefix = {}
    return index


def hashes(words: list[bytes], sizes: list[int]) -> dict[int, np.ndarray]:
    """For each size the hashes of all shingles of so many words, in the order of their places."""
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = {}
    for k in sizes:
        m = max(0, len(own) - k + 1)
        h = np.full(m, k, np.uint64)
        for i in range(k):
            h = (h ^ own[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        out[k] = h.view(np.int64)
    return out


def bitmap(keys: DataFrame) -> np.ndarray:
    """2 to BITS bits, those of keys(h) set."""
    spots = keys.select(F.col("h").bitwiseAND((1 << BITS) - 1).alias("spot"))
    marks = spots.groupBy(F.shiftright("spot", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(spot & 63 as int)))").alias("bits")).toArrow()
    table = np.zeros(1 << BITS - 6, "<i8")
    table[marks["at"].to_numpy()] = marks["bits"].to_numpy()
    return table.view(np.uint8)


def marked(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bits of some hashes are set."""
    spot = h & 8 * len(table) - 1
    return (table[spot >> 3] >> (spot & 7) & 1).astype(bool)


def joined(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, start, stop, window) of the windows found in docs, key being the digest of a text, and (window, item) of all.

    The documents are read twice, however large the benchmark is: for the counts, and for the places.
    """
    context = docs.sparkSession.sparkContext

    def shingled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text in frame["text"]:
                own = words(text)
                k = min(SHINGLE, len(own))
                if k:
                    yield pd.DataFrame({"k": k, "h": np.unique(hashes(own, [k])[k])})

    shingles = checkpoint(items.select("text").mapInPandas(shingled, "k int, h long").distinct())
    sizes = sorted(r["k"] for r in shingles.select("k").distinct().collect())
    asked = context.broadcast(bitmap(shingles))

    def sums(batches):
        counts = np.zeros(1 << SLOTS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for h in hashes(words(text.as_py()), sizes).values():
                    np.add.at(counts, h[marked(asked.value, h)] & (1 << SLOTS) - 1, 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["slot", "n"])

    got = docs.select("text").mapInArrow(sums, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << SLOTS, np.int64)
    counts[got["slot"].to_numpy()] = got["n"].to_numpy()
    rarity = context.broadcast(counts)

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for item, text in zip(frame["item"], frame["text"], strict=True):
                own = words(text)
                n = min(WINDOW, len(own))
                if not n:
                    continue
                k = min(SHINGLE, n)
                h = hashes(own, [k])[k]
                each = np.lib.stride_tricks.sliding_window_view(rarity.value[h & len(rarity.value) - 1], n - k + 1)
                for lo in range(0, len(each), 10_000):
                    place = each[lo : lo + 10_000].argmin(1)
                    at = np.arange(lo, lo + len(place))
                    texts = [b" ".join(own[i : i + n]).decode("utf-8") for i in at]
                    yield pd.DataFrame({"item": item, "n": n, "words": texts, "h": h[at + place], "place": place, "places": each[at, place]})

    rows = checkpoint(items.mapInPandas(placed, "item string, n int, words string, h long, place int, places long").withColumn("window", F.sha2("words", 256)).distinct())
    windows = rows.drop("item").dropDuplicates(["window"])
    prefix = context.broadcast(bitmap(windows))
    before, after = WINDOW - 1, WINDOW

    def around(batches):
        for batch in batches:
            keys, at, left, near, h = [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = words(text.as_py())
                for of in hashes(own, sizes).values():
                    for i in np.flatnonzero(marked(prefix.value, of)).tolist():
                        keys.append(key)
                        at.append(i)
                        left.append(min(i, before))
                        near.append([w.decode("utf-8") for w in own[max(0, i - before) : i + after]])
                        h.append(int(of[i]))
                        if len(keys) == CANDIDATES:
                            yield pa.RecordBatch.from_pydict({"key": keys, "at": at, "left": left, "near": near, "h": h}, AROUND)
                            keys, at, left, near, h = [], [], [], [], []
            yield pa.RecordBatch.from_pydict({"key": keys, "at": at, "left": left, "near": near, "h": h}, AROUND)

    # Equal texts have equal places, which meet before the join. A hash with very many is dealt by place.
    places = docs.select(digest(F.col("text")).alias("key"), "text").mapInArrow(around, "key string, at long, left int, near array<string>, h long").dropDuplicates(["key", "at", "h"])
    hot = windows.where(F.col("places") > PLACES).groupBy("h").agg(F.max("places").alias("places")).orderBy(F.desc("places"), "h").limit(HOT)
    hot = F.broadcast(checkpoint(hot.select("h", F.ceil(F.col("places") / PLACES).cast("int").alias("parts"))))
    windows = windows.join(hot, "h", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts", "places")
    places = places.join(hot, "h", "left").withColumn("part", F.pmod(F.xxhash64("key", "at"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    own = F.array_join(F.slice("near", F.greatest(F.col("left") - F.col("place"), F.lit(0)) + 1, F.col("n")), " ")
    found = places.join(windows, ["h", "part"]).where(F.col("place") <= F.col("left")).where(own == F.col("words"))
    start = F.col("at") - F.col("place")
    return checkpoint(found.select("key", start.alias("start"), (start + F.col("n")).alias("stop"), "window")), rows.select("window", "item").distinct()


#: The columns of the places with the words around them.
AROUND = pa.schema([("key", pa.string()), ("at", pa.int64()), ("left", pa.int32()), ("near", pa.list_(pa.string())), ("h", pa.int64())])


def digest(text: Column) -> Column:
    """What a text has depends on nothing but the text: its digest stands for it."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row (doc_id, n_words, n_hit, n_items, items, contaminated) for each row of docs(doc_id, text, ...).

    items are the ids, sorted as strings, of the benchmark(item_id, text) items of which a window
    occurs. Null texts have no words, on either side; an item with a null id counts under an empty
    one. Repeated rows come back as often as they came; texts of any length are searched whole; other
    columns are ignored. No text is shuffled: a benchmark of at most block_bytes is broadcast and documents are judged where they
    are read; a larger one is joined with the places that may hold its windows. Both give the same rows.
    """
    items = known(benchmark)
    index = index_of(docs, items, block_bytes)
    if index is not None:
        out = docs.select("doc_id", _found(docs, index)(F.col("text")).alias("__h")).select("doc_id", "__h.*")
    else:
        hits, owners = joined(docs, items)
        spans = hits.select("key", "start", "stop").distinct().groupBy("key").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("ends"))
        named = hits.select("key", "window").distinct().join(owners, "window").select("key", "item").distinct().groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
        by = spans.join(named, "key")
        none = F.array().cast("array<string>")
        sizes = docs.select(digest(F.col("text")).alias("key"), "doc_id", _found(docs, Index({}, {}, {}, {}, {}, {}, {}))(F.col("text"))["n_words"].alias("n_words"))
        out = sizes.join(by, "key", "left").select("doc_id", "n_words", F.coalesce("starts", none.cast("array<long>")).alias("starts"), F.coalesce("ends", none.cast("array<long>")).alias("ends"), F.coalesce("items", none).alias("items"))

    @F.pandas_udf("long")
    def hit(starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([covered(a, b) for a, b in zip(starts, ends, strict=True)], dtype="int64")

    out = out.withColumn("n_hit", F.when(F.size("starts") == 0, F.lit(0)).otherwise(hit("starts", "ends")).cast("long"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def _found(docs: DataFrame, index: Index):
    shared = docs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("n_words long, starts array<long>, ends array<long>, items array<string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.hits(t) for t in texts], columns=["n_words", "starts", "ends", "items"])

    return run


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs without a window of an item, with the columns of docs."""
    items = known(benchmark)
    index = index_of(docs, items, block_bytes)
    if index is not None:
        return docs.where(F.size(_found(docs, index)(F.col("text"))["items"]) == 0) if index.windows else docs
    bad = joined(docs, items)[0].select(F.col("key").alias("__key")).distinct()
    return docs.join(bad, digest(docs["text"]) == bad["__key"], "left_anti")


#: The same in DuckDB.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM bw))),
hit AS (SELECT rid, i, n, item_id FROM dw JOIN bw USING (n, g)),
hw AS (SELECT rid, count(DISTINCT p) AS c FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hit)) GROUP BY rid),
hi AS (SELECT rid, count(*) AS c, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hw.c, 0)::BIGINT AS n_hit, coalesce(hi.c, 0)::BIGINT AS n_items,
       sha256(coalesce(hi.l, '')) AS items_sha256, coalesce(hw.c, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""
