"""Operator 4: substring deduplication with a log-structured index of window fingerprints.

A window is ``WINDOW`` consecutive words. The index keeps, of every window, the fingerprint of its anchor: the
run of ``GRAM`` words in it with the least hash, which equal windows share and neighbouring windows mostly have in
common, so that one word in a dozen has an entry. A new batch's anchors become a sorted run, one row for each
fingerprint, which is merge-joined with the sorted immutable runs of earlier batches; when runs are many they are
compacted into one. A fingerprint met once keeps its place, one met again only the mark that it was: all its places
were handed out as candidates then. Candidates' windows are verified by a 96-bit digest of all their words, and a
word is removed if a verified window covers it.

The index lives in a folder: runs, candidates and a manifest that names them, renamed into place after each batch, so
that a batch that fails leaves the index as it was. ``FingerprintIndex.open`` goes on with it in another session.

Equal texts are one text: all windows of a text that occurs twice are repeated. Runs are bucketed and sorted by
fingerprint, so that a merge-join moves the new batch and nothing of the history. A fingerprint or window in a third
of all documents is added up by each task before it is shuffled: what the task has seen twice goes out as settled, to
any partition, and one row in its place to those who ask.

A null text has no words. Rows that repeat an id are documents like any other. An empty table gives an empty one;
other columns are ignored. Texts are known by 96 bits of two independent hashes.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import read_table, slices, texts
from gridloom.plans.scratch import Scratch, freed_shuffles, shared_dir

WINDOW, GRAM = 35, 10
BATCHES, MOST_RUNS = 3, 2
CACHE_WORDS = 500_000
#: Windows that a task holds to find those it has twice, and repeated ones that it knows of (about 100 and 12 bytes each).
HELD, KNOWN = 1 << 18, 1 << 18
TEXT_KEY = ("tk", "tl")
_A, _B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd multipliers


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of words, of runs of words and of whole windows, modulo 2 ** 64."""

    def __init__(self, window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.known: dict[bytes, int] = {}
        self.powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def words(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            import xxhash

            if len(known) > CACHE_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            return np.array([known[w] for w in words], np.uint64)

    def rolling(self, h: np.ndarray, size: int, factor: int) -> np.ndarray:
        """For each run of ``size`` hashes, the sum of the hashes times the factor's powers, by one cumulative sum."""
        n = len(h)
        if factor not in self.powers or len(self.powers[factor][0]) < n + 1:
            length = 1 << (n + 1).bit_length()
            inverse = pow(factor, -1, 1 << 64)
            up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(length, factor, np.uint64)]))
            down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(length, inverse, np.uint64)]))
            self.powers[factor] = up, down
        up, down = self.powers[factor]
        total = np.concatenate([[np.uint64(0)], np.cumsum(h * up[:n], dtype=np.uint64)])
        return (total[size:] - total[:-size]) * down[: n - size + 1]

    def anchors(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each run of ``gram`` words, and for each window the place of its anchor (leftmost of equals)."""
        grams = _mixed(self.rolling(h, self.gram, _A))
        near = np.lib.stride_tricks.sliding_window_view(grams, self.window - self.gram + 1)
        out = np.empty(len(near), np.int64)
        for at in range(0, len(near), 1 << 16):
            out[at : at + (1 << 16)] = near[at : at + (1 << 16)].argmin(axis=1)
        return grams, out + np.arange(len(near))

    def windows(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits of two independent digests of each window."""
        return _mixed(self.rolling(h, self.window, _A) ^ np.uint64(_B)), _mixed(self.rolling(_mixed(h + np.uint64(_A)), self.window, _B)) >> np.uint64(32)


def keyed(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, text, tk, tl)``: the text, empty for null, and its key."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id), body.alias("text"), F.xxhash64(body).alias("tk"), F.hash(F.lit(1), body).alias("tl"))


def anchors_of(body: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``(h, tk, tl, pos)``: the anchors of all windows of ``body(text, tk, tl)``."""

    def run(batches):
        hasher = Hasher(window, gram)
        for whole in batches:
            for batch in slices(whole):
                hs, rows, places = [], [], []
                for k, t in enumerate(texts(batch, "text")):
                    words = t.split()
                    if len(words) >= window:
                        grams, at = hasher.anchors(hasher.words(words))
                        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
                        hs.append(grams[at])
                        places.append(at)
                        rows.append(np.full(len(at), k))
                if hs:
                    pick = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), batch.column(1).take(pick), batch.column(2).take(pick), pa.array(np.concatenate(places).astype(np.int32))], names=["h", "tk", "tl", "pos"])

    return body.select("text", *TEXT_KEY).mapInArrow(run, "h long, tk long, tl int, pos int")


class FingerprintIndex:
    """Runs of ``(h, tk, tl, pos, many)``, each a table bucketed and sorted by ``h`` with one row for each ``h``."""

    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int | None = None, most_runs: int = MOST_RUNS, window: int = WINDOW, gram: int = GRAM):
        self.spark, self.root = spark, root or f"{shared_dir(spark).rstrip('/')}/fingerprints-{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.most_runs, self.window, self.gram = most_runs, window, gram
        self.runs: list[str] = []
        self.candidates: list[str] = []
        self.turn = 0

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> FingerprintIndex:
        """The index that an earlier session has left in ``root``."""
        fs, pattern = cls(spark, root)._files(f"{root}/manifest-*.json")
        path = max(str(f.getPath().toString()) for f in fs.globStatus(pattern))
        kept = json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
        index = cls(spark, root, kept["buckets"], kept["most_runs"], kept["window"], kept["gram"])
        index.runs, index.candidates, index.turn = kept["runs"], kept["candidates"], kept["turn"]
        for name in index.runs:
            if not spark.catalog.tableExists(name):
                spark.sql(f"CREATE TABLE {name} (h BIGINT, tk BIGINT, tl INT, pos INT, many BOOLEAN) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {index.buckets} BUCKETS LOCATION '{root}/{name}'")
        return index

    def _files(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _commit(self, runs: list[str], candidates: list[str]) -> None:
        """A new manifest in one step: written under another name, then renamed; the highest number counts."""
        turn = self.turn + 1
        kept = {"turn": turn, "buckets": self.buckets, "most_runs": self.most_runs, "window": self.window, "gram": self.gram, "runs": runs, "candidates": candidates}
        fs, new = self._files(f"{self.root}/.new-{uuid.uuid4().hex}")
        out = fs.create(new)
        out.write(bytearray(json.dumps(kept).encode()))
        out.close()
        _, place = self._files(f"{self.root}/manifest-{turn:09d}.json")
        if not fs.rename(new, place):
            raise OSError(f"can't rename the manifest in {self.root}")
        self.runs, self.candidates, self.turn = runs, candidates, turn

    def _delete(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        fs, path = self._files(f"{self.root}/{name}")
        fs.delete(path, True)

    def _write(self, rows: DataFrame) -> str:
        """``rows(h, t0, t1, l0, l1, p0, p1, many)`` as a run: what is least and greatest of a fingerprint's places tells one from many."""
        name = f"gridloom_run_{uuid.uuid4().hex}"
        least = rows.groupBy("h").agg(*[F.min(c).alias(c) for c in ("t0", "l0", "p0")], *[F.max(c).alias(c) for c in ("t1", "l1", "p1", "many")])
        run = least.select("h", F.col("t0").alias("tk"), F.col("l0").alias("tl"), F.col("p0").alias("pos"), F.expr("many OR t0 <> t1 OR l0 <> l1 OR p0 <> p1").alias("many"))
        with freed_shuffles(self.spark):
            run.write.bucketBy(self.buckets, "h").sortBy("h").option("compression", "zstd").option("path", f"{self.root}/{name}").saveAsTable(name)
        return name

    @staticmethod
    def _places(rows: DataFrame, many: str = "false") -> DataFrame:
        twice = [F.col(c).alias(f"{short}{k}") for c, short in (("tk", "t"), ("tl", "l"), ("pos", "p")) for k in (0, 1)]
        return rows.select("h", *twice, F.expr(many).alias("many"))

    def add(self, batch: DataFrame) -> None:
        """Index a batch of ``(h, tk, tl, pos)``. Places, new and old, whose fingerprint is now repeated become candidates."""
        name = self._write(self._places(batch))
        new = self.spark.table(name)
        own, places = new.where("many").select("h"), None
        for run in self.runs:
            old = self.spark.table(run)
            met = new.select("h").join(old.hint("merge"), "h")
            own = own.unionByName(met.select("h"))
            # places of fingerprints met once so far
            once = met.where("NOT many").select(*TEXT_KEY, "pos")
            places = once if places is None else places.unionByName(once)
        scratch, found = Scratch(self.spark, "again"), f"candidates-{uuid.uuid4().hex}"
        # both sides are scans that are shuffled, so that Spark splits a fingerprint that has a large part of the batch
        again = scratch.save(own.distinct(), "again")
        here = batch.join(again.hint("merge"), "h", "left_semi").select(*TEXT_KEY, "pos")
        with freed_shuffles(self.spark):
            (here if places is None else here.unionByName(places)).write.parquet(f"{self.root}/{found}")
        scratch.drop("again")
        self._commit([*self.runs, name], [*self.candidates, found])
        if len(self.runs) > self.most_runs:
            self.compact()

    def compact(self) -> None:
        """Merge all runs into one and delete them."""
        old, every = self.runs, None
        for name in old:
            rows = self._places(self.spark.table(name), "many")
            every = rows if every is None else every.unionByName(rows)
        self._commit([self._write(every)], self.candidates)
        for name in old:
            self._delete(name)

    def found(self) -> DataFrame:
        """``(tk, tl, pos)``: all candidates so far; one may occur in several batches."""
        return self.spark.read.schema("tk long, tl int, pos int").parquet(*[f"{self.root}/{c}" for c in self.candidates])

    def clear(self) -> None:
        """Delete the index."""
        for name in self.runs:
            self._delete(name)
        fs, path = self._files(self.root)
        fs.delete(path, True)
        self.runs, self.candidates = [], []


#: What a row of a window's digest is: to be settled, settled and standing for its digest, settled.
ASKS, STANDS, SETTLED = 0, 1, 2


class Combiner:
    """Finds the windows that a task has twice before they are shuffled."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0
        self.known = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, a: np.ndarray, b: np.ndarray, tk: np.ndarray, tl: np.ndarray):
        self.held.append((a, b, tk, tl))
        self.size += len(a)
        if self.size >= HELD:
            yield self.settle()

    def settle(self) -> pa.RecordBatch:
        a, b, tk, tl = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.size = [], 0
        order = np.lexsort((b, a))
        a, b, tk, tl = a[order], b[order], tk[order], tl[order]
        high = b >> 32
        edge = np.concatenate([[True], (a[1:] != a[:-1]) | (high[1:] != high[:-1])])
        begins, group = np.flatnonzero(edge), np.cumsum(edge) - 1
        first = begins[group]
        twice = np.bincount(group, (b != b[first]) | (tk != tk[first]) | (tl != tl[first]), len(begins)) > 0
        at = np.minimum(np.searchsorted(self.known[0], a[begins]), max(0, len(self.known[0]) - 1))
        known = (self.known[0][at] == a[begins]) & (self.known[1][at] == high[begins]) if len(self.known[0]) else np.zeros(len(begins), bool)
        settled = (twice | known)[group]
        stand = begins[twice & ~known]
        # digests that come often are remembered, so that they are asked for once
        often = twice & ~known & (np.diff(np.append(begins, len(a))) >= 4)
        more = np.concatenate([self.known[0], a[begins[often]]]), np.concatenate([self.known[1], high[begins[often]]])
        if len(more[0]) > KNOWN:
            more = a[begins[often]], high[begins[often]]
        rank = np.argsort(more[0], kind="stable")
        self.known = more[0][rank], more[1][rank]
        kind = np.where(settled, SETTLED, ASKS).astype(np.int8)
        # settled rows go anywhere
        key = np.where(settled, _mixed(tk.view(np.uint64) + b.view(np.uint64)), a)
        columns = [np.concatenate([key, a[stand]]).view(np.int64), np.concatenate([b, b[stand]]), np.concatenate([tk, tk[stand]]), np.concatenate([tl, tl[stand]]), np.concatenate([kind, np.full(len(stand), STANDS, np.int8)])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "tk", "tl", "kind"])


def verified(body: DataFrame, candidates: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``(tk, tl, pos)``: the windows of ``body(text, tk, tl)`` that start elsewhere too, out of those with a candidate anchor."""
    places = candidates.groupBy(*TEXT_KEY).agg(F.collect_set("pos").alias("places"))

    def digests(batches):
        hasher, combiner = Hasher(window, gram), Combiner()
        before = None
        for whole in batches:
            for batch in slices(whole):
                for t, k, l, p in zip(texts(batch, "text"), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                    if (k, l) == before:
                        continue
                    before = k, l
                    h = hasher.words(t.split())
                    _, at = hasher.anchors(h)
                    marked = np.zeros(len(h), bool)
                    marked[p.values.to_numpy()] = True
                    start = np.flatnonzero(marked[at])
                    a, b = hasher.windows(h)
                    yield from combiner.add(a[start], ((b[start] << np.uint64(32)) | start.astype(np.uint64)).view(np.int64), np.full(len(start), k, np.int64), np.full(len(start), l, np.int32))
        if combiner.size:
            yield combiner.settle()

    def repeated(batches):
        held: list[np.ndarray] | None = None  # the first row of the group that goes on
        pending = False
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy() for i in range(5)]
            sure = columns[4] == SETTLED
            done = [c[sure] for c in columns[1:4]]
            a, b, k, l, kind = (c[~sure] for c in columns)
            if len(a):
                if held is not None:
                    a, b, k, l, kind = (np.concatenate([x, y]) for x, y in zip(held, (a, b, k, l, kind)))
                high = b >> 32
                edge = np.flatnonzero((a[1:] != a[:-1]) | (high[1:] != high[:-1])) + 1
                begins = np.concatenate([[0], edge])
                group = np.zeros(len(a), np.int64)
                group[edge] = 1
                group = np.cumsum(group)
                # a group is repeated if not all its rows are of one text and place, or one stands for it
                first = begins[group]
                differs = (b != b[first]) | (k != k[first]) | (l != l[first]) | (kind == STANDS)
                yes = np.bincount(group, differs, len(begins)) > 0
                yes[0] |= pending
                out = yes[group] & (kind == ASKS)
                if held is not None and pending:
                    out[0] = False  # given out before
                last = begins[-1]
                if not yes[-1]:
                    out[last:] = False
                pending = bool(yes[-1])
                held = [x[last : last + 1] for x in (a, b, k, l, kind)]
                done = [np.concatenate([x, y[out]]) for x, y in zip(done, (b, k, l))]
            if len(done[0]):
                yield pa.RecordBatch.from_arrays([pa.array(done[1]), pa.array(done[2]), pa.array((done[0] & 0xFFFFFFFF).astype(np.int32))], names=["tk", "tl", "pos"])

    rows = body.join(places.hint("merge"), list(TEXT_KEY)).select("text", *TEXT_KEY, "places").mapInArrow(digests, "a long, b long, tk long, tl int, kind tinyint")
    return rows.repartition("a").sortWithinPartitions("a", "b", "tk", "tl").mapInArrow(repeated, "tk long, tl int, pos int")


def keep_words(body: DataFrame, windows: DataFrame, copies: DataFrame, window: int = WINDOW) -> DataFrame:
    """``body`` with ``n_words``, ``n_removed`` and ``kept`` (the words that stay, one space between them, as bytes)."""
    key = list(TEXT_KEY)
    starts = windows.groupBy(*key).agg(F.collect_list("pos").alias("starts"))
    marks = starts.join(copies.select(*key, F.lit(True).alias("twice")), key, "full")
    names = [c for c in body.columns if c not in ("text", *key)]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in body.schema.fields if f.name in names)

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                count, gone, kept = [], [], []
                pick = lambda c: batch.column(batch.schema.get_field_index(c))
                for t, s, twice in zip(texts(batch, "text"), pick("starts"), pick("twice").to_pylist()):
                    words = t.split()
                    n = len(words)
                    if twice and n >= window:
                        words = []
                    elif s.is_valid:
                        at = s.values.to_numpy()
                        change = np.bincount(at, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(at + window, n), minlength=n + 1)[: n + 1]
                        stays = np.cumsum(change)[:n] == 0
                        words = [w for w, k in zip(words, stays.tolist()) if k]
                    count.append(n)
                    gone.append(n - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([*(pick(c) for c in names), pa.array(count, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], names=[*names, "n_words", "n_removed", "kept"])

    return body.join(marks, key, "left").mapInArrow(run, f"{kinds}, n_words long, n_removed long, kept binary")


def judged(spark: SparkSession, docs: DataFrame, index: FingerprintIndex, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_words, n_removed, kept)`` for ``docs``, which are all that ``index`` holds."""
    scratch = Scratch(spark, "substrings")
    body = keyed(docs, id, text)
    copies = scratch.save(body.groupBy(*TEXT_KEY).count().where("count > 1").select(*TEXT_KEY), "copies")
    repeated = scratch.save(verified(body.select("text", *TEXT_KEY), index.found(), index.window, index.gram), "windows")
    return keep_words(body, repeated, copies, index.window)


def deduplicate(spark: SparkSession, docs: DataFrame, id: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """``(id, n_words, n_removed, kept)``: documents arrive in batches; windows are judged on all of them."""
    scratch, index = Scratch(spark, "anchors"), FingerprintIndex(spark)
    anchors = scratch.save(anchors_of(keyed(docs, id, text)), "anchors")
    for k in range(batches):
        index.add(anchors.where(F.pmod(F.xxhash64(*TEXT_KEY), F.lit(batches)) == k))
    scratch.drop("anchors")
    out = judged(spark, docs, index, id, text)
    index.clear()
    return out


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = deduplicate(spark, read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op4_substring_dedup": op4_substring_dedup}
ORACLE_SQL: dict[str, str] = {
    "op4_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 starts AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35),
 win AS (SELECT r, s, md5(array_to_string(list_slice(w, s, s + 34), ' ')) AS g FROM starts),
 dup AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
 gone AS (SELECT DISTINCT r, s + o AS p FROM dup, (SELECT unnest(range(35)) AS o)),
 word AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
 kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""
}
