"""A persistent lexical index: build, search, explain, update, segments, views.

All data are Parquet tables (chunks, postings by term, lexicon, tombstones, ledger) named by the commit log; every answer is a Spark plan over the tables of one snapshot.

Each folder of postings has a lexicon beside it (df of its own rows), each folder of tombstones one with what they take away, and commits carry the numbers of rows, tokens and postings. So a search, an append or a
publish reads the lexicon of the terms it needs and the numbers of the log, never the postings or chunks of the whole index.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from copy import deepcopy

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.text import as_column, series_udf, tokenizer_status, tokens
from ..log import log, warn
from ..operators import bm25, chunks as chunking, explain as explaining, views as viewing
from ..operators.postings import Stats, counted, lexicon, weights
from ..plans.routing import COMPACT_BLOCKS, Route, route_update
from ..sources import files as sources
from ..sources.local import local_rows
from ..sources.cut import cut_lineage
from .store import Snapshot, Store

#: unknown: words that have no posting, as the vocabulary was closed when the row came.
CHUNKS = "row long, docid string, file string, line int, text string, dl long, unknown array<string>"
POSTINGS = "row long, dl long, term string, tf long"
LEXICON = "term string, df long"
TABLES = ("chunks", "postings", "lexicon")
#: Query terms up to this number are pushed to the postings' scan as literals, where row groups are skipped by term.
PUSHED = 512
#: Rows up to this number are written to one file a table, without a sample for ranges.
SMALL = 1_000
#: Deltas that are merged into one; share of the base's postings in deltas at which all is rewritten.
COMPACT_COMMITS, COMPACT_RATIO = 16, 0.3
CONFIG = {"approx_topk": False, "materialised": False, "persist": "delta", "compact_commits": COMPACT_COMMITS, "compact_ratio": COMPACT_RATIO, "compact_blocks": COMPACT_BLOCKS, "rebuild_batch_nnz": None, "w_cache": False}


def numbered(df: DataFrame, order: list[str], base: int, name: str = "row") -> tuple[DataFrame, int]:
    """Consecutive numbers from `base` in the order of `order`, without a single-task window: places within range partitions after the partitions' counts. And how many rows there are."""
    low = F.lit((1 << 33) - 1)
    parted = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(parted.withColumn("_id", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_id", 33)).withColumn("_i", F.col("_id").bitwiseAND(low)))
    counts = sorted((r["_p"], r["count"]) for r in placed.groupBy("_p").count().collect())  # a row for each partition
    offsets, total = [], base
    for p, n in counts:
        offsets.append((p, total))
        total += n
    table = local_rows(df.sparkSession, offsets, "_p long, _base long")
    return placed.join(F.broadcast(table), "_p").withColumn(name, F.col("_base") + F.col("_i")).drop("_id", "_p", "_i", "_base"), total - base


class Index:
    def __init__(self, spark: SparkSession, path: str, upto: int | None = None, tokenize=tokens):
        self.spark, self.store, self.tokenize = spark, Store(spark, path), tokenize
        if not self.store.log():
            raise FileNotFoundError(f"no index at {path}")
        self.state, self.load_report = self.store.replay(upto)
        #: Tags of segments whose folders have gone; their rows are left out, and `remount` reports them.
        self.stale = {s["tag"] for s in self.state.segments if not all(self.store.files.exists(f"{s['dir']}/{x}") for x in TABLES)}
        for tag in self.stale:
            warn(f"segment {tag} is incomplete and left out")
        self._views: dict[str, dict] = {}
        self.settings = dict(CONFIG)

    # build and open

    @classmethod
    def create(cls, spark: SparkSession, path: str, texts: DataFrame, k1: float | None = None, b: float | None = None, tokenize=tokens, ledger: DataFrame | None = None, root: str | None = None) -> Index:
        """An index of (docid, file, line, text) rows in the order of file, line and docid. On an existing index: a reset."""
        store = Store(spark, path)
        state = store.replay()[0]
        folder, size = _write_part(store, texts, 0, tokenize)
        actions = {"sizes": {folder: size}, "k1": k1 if k1 is not None else state.k1, "b": b if b is not None else state.b, "root": root}
        if ledger is not None:
            actions["ledger"] = [_write_ledger(store, ledger, state.seq + 1)]
        store.commit(state, "reset", size["rows"], parts=[folder], **actions)
        log(f"index of {size['rows']} rows at {path}")
        return cls(spark, path, tokenize=tokenize)

    @classmethod
    def build(cls, spark: SparkSession, root: str, path: str, skip_dirs: Iterable[str] = (), tokenize=tokens) -> Index:
        """An index of the files under `root`."""
        scanned = sources.scan(spark, root, skip_dirs).persist(StorageLevel.MEMORY_AND_DISK)
        texts = _chunk(scanned).persist(StorageLevel.MEMORY_AND_DISK)  # numbering reads it twice, the ledger once
        ledger = scanned.join(texts.select(F.col("file").alias("rel")).distinct(), "rel", "left_semi").select("rel", "md5", "size", "mtime_ns")
        out = cls.create(spark, path, texts, tokenize=tokenize, ledger=ledger, root=root)
        texts.unpersist()
        scanned.unpersist()
        return out

    # tables of the snapshot

    def _folders(self) -> list[str]:
        return [*self.state.parts, *(s["dir"] for s in self.state.segments if s["tag"] not in self.stale)]

    def _read(self, folders: list[str], table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{f}/{table}" for f in folders)) if folders else local_rows(self.spark, [], schema)

    def all_chunks(self) -> DataFrame:
        return self._read(self._folders(), "chunks", CHUNKS)

    def dead(self) -> DataFrame:
        return self._read(self.state.dead, "dead", "row long").distinct()

    def chunks(self) -> DataFrame:
        """Live chunks."""
        return self.all_chunks().join(self.dead(), "row", "left_anti") if self.state.dead else self.all_chunks()

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """Live postings; with `terms` only those of the terms."""
        found = self._read(self._folders(), "postings", POSTINGS)
        if terms is not None:
            found = found.where(F.col("term").isin(terms)) if len(terms) <= PUSHED else found.join(local_rows(self.spark, [(t,) for t in terms], "term string"), "term", "left_semi")
        return found.join(self.dead(), "row", "left_anti") if self.state.dead else found

    def vocabulary(self, terms: list[str] | None = None) -> DataFrame:
        """(term): never shrinks, so it may hold terms without a live document. Read from the lexicons."""
        return self._of_terms(self._read(self._folders(), "lexicon", LEXICON), terms).select("term").distinct()

    def _of_terms(self, table: DataFrame, terms: list[str] | None) -> DataFrame:
        if terms is None:
            return table
        return table.where(F.col("term").isin(terms)) if len(terms) <= PUSHED else table.join(local_rows(self.spark, [(t,) for t in terms], "term string"), "term", "left_semi")

    def lexicon(self, terms: list[str] | None = None) -> DataFrame:
        """(term, df) over live rows, 0 for a term that only tombstoned rows hold: the lexicons of all parts less those of the tombstones."""
        if self.stale and self.state.dead:  # tombstones may be of rows that are left out
            return self.vocabulary(terms).join(lexicon(self.postings(terms)), "term", "left").na.fill(0, ["df"])
        return self._of_terms(self._read([*self._folders(), *self.state.dead], "lexicon", LEXICON), terms).groupBy("term").agg(F.sum("df").alias("df"))

    def numbers(self) -> Stats:
        """From the commits; only where a segment is stale and rows are tombstoned are chunks read."""
        if self.stale and self.state.dead:
            got = self.chunks().agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("s")).first()
            return Stats(self.state.n_rows, got["n"], got["s"], self.state.k1, self.state.b)
        n, dl = (self.state.total(x, self._folders()) - self.state.gone[x] for x in ("rows", "dl"))
        return Stats(self.state.n_rows, n, dl, self.state.k1, self.state.b)

    def ledger(self) -> DataFrame:
        events = self._read(self.state.ledger, "ledger", f"seq long, {sources.LEDGER}")
        last = events.groupBy("rel").agg(F.max_by(F.struct("md5", "size", "mtime_ns"), "seq").alias("e"))
        return last.select("rel", "e.*").where("md5 is not null")

    # queries

    def _terms(self, queries: list[str]) -> tuple[DataFrame, list[str]]:
        asked = local_rows(self.spark, list(enumerate(queries)), "qid int, query string").select("qid", self.tokenize(F.col("query")).alias("toks"))
        rows = sorted({(r["qid"], t) for r in asked.collect() for t in r["toks"]})  # as many as the caller's own words; Spark's own tokens need no job for this
        return local_rows(self.spark, rows, "qid int, term string"), sorted({t for _, t in rows})

    def _lexicon_of(self, words: list[str]) -> DataFrame:
        """Lexicon rows of the words as a local table: as many rows as words at most."""
        return local_rows(self.spark, [(r["term"], r["df"]) for r in self.lexicon(words).collect()] if words else [], LEXICON)

    def scores(self, queries: list[str]) -> DataFrame:
        """(qid, row, score) of all live rows with a query term."""
        terms, words = self._terms(queries)
        if self.settings["materialised"]:
            return bm25.weighted_scores(self._of_terms(self.weights(), words), terms)
        return bm25.scores(self.postings(words), self._lexicon_of(words), terms, self.numbers())

    def search_batch(self, queries: list[str], k: int = 10, with_text: bool = True) -> list[list[dict]]:
        """Hits of each query, best first: rank, score, docid, file, line, text. One job for all queries."""
        if k <= 0 or not queries:
            return [[] for _ in queries]
        scored = self.scores(queries)
        if len(queries) > 1:
            best = bm25.top_k(scored, k).select("qid", "rank", "score", "row").collect()  # at most k a query
        else:
            one = scored.select("row", "score")
            if self.settings["approx_topk"]:
                one = one.persist(StorageLevel.MEMORY_AND_DISK)  # the sample, the candidates and the fallback read it
                top = bm25.approximate_top_k(one, k).collect()
                one.unpersist()
            else:
                top = bm25.top_k_single(one, k).collect()
            best = [{"qid": 0, "rank": i + 1, "score": r["score"], "row": r["row"]} for i, r in enumerate(sorted(top, key=lambda r: (-r["score"], r["row"])))]
        held = self._chunks_of([r["row"] for r in best], ["docid", "file", "line", *(["text"] if with_text else [])])
        out: list[list[dict]] = [[] for _ in queries]
        for r in sorted(best, key=lambda r: (r["qid"], r["rank"])):
            out[r["qid"]].append({"rank": r["rank"], "score": r["score"], **held[r["row"]]})
        return out

    def _chunks_of(self, rows: list[int], columns: list[str]) -> dict[int, dict]:
        """Columns of a few rows. Their numbers go to the scan as literals, where files and row groups without them are skipped."""
        wanted = sorted(set(rows))
        found = self.all_chunks().select("row", *columns)
        found = found.where(F.col("row").isin(wanted)) if len(wanted) <= PUSHED else found.join(local_rows(self.spark, [(r,) for r in wanted], "row long"), "row")
        return {r["row"]: {c: r[c] for c in columns} for r in found.collect()} if wanted else {}

    def search(self, query: str, k: int = 10, with_text: bool = True) -> list[dict]:
        return self.search_batch([query], k, with_text)[0]

    def topk(self, query: str, k: int) -> list[tuple[int, float]]:
        """Exactly min(k, rows) (row, score), also rows that score 0 and tombstoned ones; nothing if no term is known."""
        _, words = self._terms([query])
        if not words or self.vocabulary(words).isEmpty():
            return []
        return [(r["row"], r["score"]) for r in bm25.zero_filled(self.all_chunks(), self.scores([query]), k).collect()]

    def weights(self) -> DataFrame:
        """Materialised weights of this snapshot, made anew whenever its key changes; not while segments are mounted. With the setting w_cache a commit names them, so that they outlive the session."""
        if self.state.segments:
            raise RuntimeError("weights are not kept while segments are mounted")
        key = {"data": self.state.data, "k1": self.state.k1, "b": self.state.b}
        kept = [w for w in (getattr(self, "_weights", None), self.state.weights) if w is not None and w["key"] == key]
        if not kept:
            folder = self.store.folder("weights")
            weights(self.postings(), self.lexicon(), self.numbers()).sortWithinPartitions("term").write.parquet(folder)  # where the join by term has put and sorted them: no other sort
            kept = [{"key": key, "dir": folder}]
        self._weights = kept[0]
        if self.settings["w_cache"] and self.state.weights != kept[0]:
            self.state = self.store.commit(self.state, "weights", self.state.n_rows, weights=kept[0])
        return self.spark.read.schema("term string, row long, w double").parquet(kept[0]["dir"])

    def explain(self, query: str, docid: str | None = None, k: int = 1, top: int = 6, diagnose: bool = False):
        """Term rows of the hit of rank `k` (of the last hit, if there are fewer), or of the best chunk whose file name contains `docid`: contributions first (at most `top`), then terms without one.

        A chunk of a stale segment that is only known by its chunks has known terms `unavailable`, without a frequency or contribution.
        """
        scored = self.scores([query]).where("score > 0")
        lost = False
        if docid is not None:
            named = self.chunks().where(F.contains(F.col("file"), F.lit(docid))).select("row")
            first = named.agg(F.min("row")).first()[0]
            best = bm25.top_k_single(scored.join(named, "row", "left_semi").select("row", "score"), 1).collect() if first is not None else []
            if first is None:
                halves = [s["dir"] for s in self.state.segments if s["tag"] in self.stale and self.store.files.exists(f"{s['dir']}/chunks")]
                first = self._read(halves, "chunks", CHUNKS).where(F.contains(F.col("file"), F.lit(docid))).agg(F.min("row")).first()[0]
                lost = True
            if first is None:
                raise KeyError(docid)
            best = best or [{"row": first}]
        else:
            best = bm25.top_k_single(scored.select("row", "score"), max(1, k)).collect()
        out = []
        if best:
            counts = explaining.term_counts(local_rows(self.spark, [(0, query)], "qid int, query string"))
            _, words = self._terms([query])
            asked = local_rows(self.spark, [(0, best[-1]["row"])], "qid int, row long")
            rows = explaining.explain(self.postings(words), self._lexicon_of(words), counts, asked, self.numbers()).orderBy(F.desc("contribution"), "term").collect()
            rows = [r.asDict() for r in rows]
            if lost:
                rows = [r | ({"status": "unavailable", "tf": None, "contribution": None} if r["status"] != "oov" else {}) for r in rows]
            shown = [r for r in rows if r["status"] == "ok"][: max(top, 0)] + [r for r in rows if r["status"] != "ok"]
            out = [{"row": r["row"], "term": r["term"], "q_count": r["q_count"], "in_vocab": r["status"] != "oov", **{c: r[c] for c in ("status", "tf", "df", "idf", "contribution")}} for r in shown]
        return {"contributions": out, "diagnosis": self.diagnose(query, k)} if diagnose else out

    def diagnose(self, query: str, k: int = 10) -> dict:
        counts = explaining.term_counts(local_rows(self.spark, [(0, query)], "qid int, query string"))
        asked, words = self._terms([query])
        lex, stats = self._lexicon_of(words), self.numbers()
        terms = explaining.diagnose_terms(lex, counts, stats).orderBy("term").drop("qid").collect()
        got = bm25.scores(self.postings(words), lex, asked, stats).where("score > 0").agg(F.count("*").alias("n"), F.max("score").alias("m")).first()
        return explaining.diagnosis(query, terms, got["n"], got["m"] or 0.0, stats.n_live, k)

    # browsing

    def browse(self, page: int = 0, n: int = 20, file: str | None = None) -> tuple[list[dict], int]:
        rows = self.chunks()
        if file is not None:
            rows = rows.where(F.translate(F.col("file"), "\\", "/") == file.replace("\\", "/"))
        found = rows.orderBy("row").offset(page * n).limit(n).select("row", "docid", "file", "line", "text").collect()
        return [r.asDict() for r in found], rows.count()

    def rows(self, first: int, n: int) -> DataFrame:
        """Live chunks of the row numbers first .. first + n - 1; the range is pushed to the scan."""
        return self.chunks().where((F.col("row") >= first) & (F.col("row") < first + n))

    def files(self) -> list[str]:
        return [r["file"] for r in self.chunks().select("file").distinct().orderBy("file").collect()]

    def stats(self) -> dict:
        s = self.numbers()
        return {"rows": s.n_rows, "live": s.n_live, "avgdl": s.avgdl, "k1": s.k1, "b": s.b, "nnz": self.state.total("nnz", self._folders()), "terms": self.vocabulary().count(), "files": self.chunks().select("file").distinct().count(), "segments": len(self.state.segments), "commit": self.state.seq, "settings": dict(self.settings), "tokenizer": tokenizer_status()}

    # changes

    def _plain(self, what: str) -> None:
        if self.state.segments:
            raise RuntimeError(f"{what} is refused while segments are mounted: fold or unmount them first")

    def append(self, texts: DataFrame, dead: DataFrame | None = None, **actions) -> int:
        """Add (docid, file, line, text) rows under the closed vocabulary: unknown terms get no posting but count in the length. `dead`: rows that go in the same commit."""
        self._plain("append")
        folder, size = _write_part(self.store, texts, self.state.n_rows, self.tokenize, self.vocabulary)
        self.state = self.store.commit(self.state, "append", self.state.n_rows + size["rows"], parts=[folder], sizes={folder: size}, **self._write_dead(dead), **actions)
        log(f"{size['rows']} rows appended")
        self._maybe_compact()
        return size["rows"]

    def _write_dead(self, rows: DataFrame | None) -> dict:
        """Write tombstones with the lexicon that they take away; what the commit says of them."""
        if rows is None:
            return {}
        new = rows.select(F.col("row").cast("long").alias("row")).where((F.col("row") >= 0) & (F.col("row") < self.state.n_rows)).distinct()
        new = cut_lineage(new.join(self.dead(), "row", "left_anti") if self.state.dead else new)
        few = [r["row"] for r in new.limit(PUSHED + 1).collect()]
        chunks = self.all_chunks()
        held = chunks.where(F.col("row").isin(few)) if len(few) <= PUSHED else chunks.join(new, "row", "left_semi")
        folder = self.store.folder("dead")
        return {"dead": [folder], "gone": self._write_tombstones(folder, new, held)}

    def _write_tombstones(self, folder: str, rows: DataFrame, chunks: DataFrame) -> dict:
        """Rows, and the negative lexicon of their chunks: a chunk's words are those of its text that had a posting. Returns rows and tokens that go."""
        rows.write.parquet(f"{folder}/dead")
        words = F.array_except(self.tokenize(F.col("text")), F.coalesce("unknown", F.array().cast("array<string>")))
        exploded = chunks.select(F.explode_outer(words).alias("term")).where("term is not null")
        exploded.groupBy("term").agg((-F.count("*")).alias("df")).write.parquet(f"{folder}/lexicon")
        got = chunks.agg(F.count("*").alias("rows"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
        return got.asDict()

    def delete(self, rows: DataFrame, **actions) -> None:
        """Tombstone rows; unknown ones and repeats don't matter."""
        self.state = self.store.commit(self.state, "append", self.state.n_rows, **self._write_dead(rows), **actions)

    def upsert(self, rows: DataFrame, texts: DataFrame) -> range:
        """Tombstone `rows` and add `texts` in one commit; the new row numbers, in the order of file, line and docid."""
        first = self.state.n_rows
        return range(first, first + self.append(texts, rows))

    def tune(self, k1: float | None = None, b: float | None = None, persist: bool = False) -> dict:
        """Other parameters, without touching any table."""
        before = {"k1": self.state.k1, "b": self.state.b}
        after = {"k1": before["k1"] if k1 is None else float(k1), "b": before["b"] if b is None else float(b)}
        if persist:
            self.state = self.store.commit(self.state, "params", self.state.n_rows, **after)
        else:
            self.state.k1, self.state.b = after["k1"], after["b"]
        return {"before": before, "after": after, "persisted": persist}

    def config(self, **settings) -> dict:
        if unknown := settings.keys() - self.settings.keys():
            raise KeyError(f"unknown settings: {sorted(unknown)}")
        if settings.get("persist", "delta") not in ("delta", "snapshot"):
            raise ValueError("persist must be 'delta' or 'snapshot'")
        before = dict(self.settings)
        self.settings |= settings
        return {"before": before, "after": dict(self.settings)}

    def _maybe_compact(self) -> dict | None:
        """Tier 2, a full rewrite, once the deltas hold `compact_ratio` of the base's postings (or for each change with persist='snapshot'); tier 1, the deltas merged into one with the base untouched, once there are `compact_commits` of them."""
        if self.state.segments:
            return None
        if self.settings["persist"] == "snapshot":
            return self.compact()
        base, deltas = self.state.parts[: self.state.base], self.state.parts[self.state.base :]
        if self.state.total("nnz", deltas) > self.settings["compact_ratio"] * max(1, self.state.total("nnz", base)):
            return self.compact()
        if max(len(deltas), len(self.state.dead)) >= self.settings["compact_commits"]:
            return self.merge_deltas()
        return None

    def _rewritten(self, parts: list[str]) -> tuple[str, dict]:
        """One folder with the rows of several."""
        folder = self.store.folder("part")
        size = {x: self.state.total(x, parts) for x in ("rows", "dl", "nnz")}
        chunks, posts, lex = self._read(parts, "chunks", CHUNKS), self._read(parts, "postings", POSTINGS), self._read(parts, "lexicon", LEXICON)
        # rows stay in the files' order: parts hold ranges of rows, and each of their postings' files has all terms
        (chunks if size["rows"] > SMALL else chunks.coalesce(1)).write.parquet(f"{folder}/chunks")
        (posts if size["rows"] > SMALL else posts.coalesce(1)).sortWithinPartitions("term", "row").write.parquet(f"{folder}/postings")
        _by_term(lex.groupBy("term").agg(F.sum("df").alias("df")), size["rows"], "term").write.parquet(f"{folder}/lexicon")
        return folder, size

    def _dead_rewritten(self) -> list[str]:
        """One folder for all tombstones; their lexicons are added up."""
        if not self.state.dead:
            return []
        folder = self.store.folder("dead")
        self.dead().write.parquet(f"{folder}/dead")
        self._read(self.state.dead, "lexicon", LEXICON).groupBy("term").agg(F.sum("df").alias("df")).write.parquet(f"{folder}/lexicon")
        return [folder]

    def merge_deltas(self) -> dict:
        """Tier 1: all parts after the base become one, and all tombstones; nothing of the base is read or written."""
        self._plain("merge_deltas")
        base, deltas = self.state.parts[: self.state.base], self.state.parts[self.state.base :]
        folder, size = self._rewritten(deltas) if len(deltas) > 1 else (None, None)
        parts = [*base, folder] if folder else list(self.state.parts)
        dead = self._dead_rewritten() if len(self.state.dead) > 1 else list(self.state.dead)
        self.state = self.store.commit(self.state, "compact", self.state.n_rows, tier=1, replace={"parts": parts, "dead": dead}, sizes={folder: size} if folder else {})
        log(f"{len(deltas)} deltas merged, the base untouched")
        return {"tier": 1, "merged": len(deltas), "parts": len(parts)}

    # segments

    def publish(self, texts: DataFrame, dead: DataFrame | None = None, tag: str | None = None, kind: str = "publish", generation: int | None = None, **actions) -> dict:
        """Add rows as a read-only segment with terms of its own; visible by one commit. `generation`: a number of the caller's, kept with the segment."""
        tag = self._free_tag(tag)
        folder, size = _write_part(self.store, texts, self.state.n_rows, self.tokenize)
        return self._mount(folder, tag, dead, kind, size, generation, **actions)

    def _free_tag(self, tag: str | None) -> str:
        if self.store.log()[-1] != self.state.seq:
            raise RuntimeError("the index has moved on: open it again")
        tag = tag or f"seg-{self.state.seq + 1:06d}"
        if any(s["tag"] == tag for s in self.state.segments) or tag in self.state.folded:
            raise ValueError(f"segment {tag} exists")
        return tag

    def _mount(self, folder: str, tag: str | None, dead: DataFrame | None, kind: str, size: dict | None = None, generation: int | None = None, **actions) -> dict:
        tag = self._free_tag(tag)
        if size is None:  # written by another session
            got = self._read([folder], "chunks", CHUNKS).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl"), F.min("row").alias("first"), F.max("row").alias("last")).first()
            if got["n"] and (got["first"] != self.state.n_rows or got["last"] + 1 - got["first"] != got["n"]):
                raise RuntimeError(f"the segment begins at row {got['first']}, the index ends at {self.state.n_rows}")
            size = {"rows": got["n"], "dl": got["dl"], "nnz": self._read([folder], "lexicon", LEXICON).agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]}
        new_terms = self._read([folder], "lexicon", LEXICON).join(self.vocabulary(), "term", "left_anti").count()
        info = {"tag": tag, "dir": folder, "row_base": self.state.n_rows, "rows": size["rows"], "new_terms": new_terms, "generation": generation}
        self.state = self.store.commit(self.state, kind, self.state.n_rows + size["rows"], segment=info, sizes={folder: size}, **self._write_dead(dead), **actions)
        log(f"segment {tag} of {size['rows']} rows mounted")
        return info

    def write_segment(self, texts: DataFrame) -> str:
        """A folder of rows that `mount` can take later, in this session or another; no commit is made."""
        return _write_part(self.store, texts, self.state.n_rows, self.tokenize)[0]

    def mount(self, folder: str, tag: str | None = None, generation: int | None = None) -> dict:
        """Make the rows of a folder visible as a read-only segment. The folder must have been written for this number of rows."""
        if not self.store.files.exists(folder):
            raise FileNotFoundError(folder)
        return self._mount(folder, tag, None, "mount", None, generation)

    def segments(self) -> list[dict]:
        return [dict(s) for s in self.state.segments]

    def remount(self) -> list[dict]:
        """A row for each segment that commits name: `mounted`, `folded`, or `stale` with the reason, if its folder has gone."""
        out = [{"tag": t, "status": "folded", "reason": None} for t in self.state.folded]
        for s in self.state.segments:
            stale = s["tag"] in self.stale
            out.append({"tag": s["tag"], "status": "stale" if stale else "mounted", "reason": f"{s['dir']} is incomplete" if stale else None})
        return out

    def _segment(self, tag: str) -> dict:
        if tag in self.state.folded:
            raise RuntimeError(f"segment {tag} is folded")
        for s in self.state.segments:
            if s["tag"] == tag:
                return s
        raise KeyError(tag)

    def unmount(self, tag: str) -> dict:
        """Withdraw the segment mounted last; scores are those of before."""
        s = self._segment(tag)
        if self.state.segments[-1]["tag"] != tag:
            raise RuntimeError("segments are unmounted in the reverse order of mounting")
        if s["row_base"] + s["rows"] != self.state.n_rows:
            raise RuntimeError("rows were added since")
        back = self.dead().where(F.col("row") >= s["row_base"]) if self.state.dead else None
        actions = {}
        if back is not None and not back.isEmpty():  # tombstones inside the segment go with it
            folder = self.store.folder("dead")
            left = self.dead().where(F.col("row") < s["row_base"])
            kept = self._write_tombstones(folder, left, self.all_chunks().join(left, "row", "left_semi"))
            actions = {"replace": {"dead": [folder]}, "gone": {k: kept[k] - self.state.gone[k] for k in kept}}
        self.state = self.store.commit(self.state, "unmount", s["row_base"], unmount=[tag], **actions)
        return dict(s)

    def fold(self, tag: str) -> dict:
        """Make a segment part of the index; no row is rewritten and no score changes."""
        s = dict(self._segment(tag))
        if tag in self.stale:
            raise RuntimeError(f"segment {tag} is stale")
        self.state = self.store.commit(self.state, "fold", self.state.n_rows, fold=[tag])
        return s

    def fold_all(self) -> list[str]:
        tags = [s["tag"] for s in self.state.segments if s["tag"] not in self.stale]
        if tags:
            self.state = self.store.commit(self.state, "fold", self.state.n_rows, fold=tags)
        return tags

    def compact(self, persist: bool | str = True) -> dict:
        """Fold everything and rewrite the tables in one folder each (tier 2). Tombstoned rows stay, as numbers of rows and the vocabulary do.

        persist='delta': only fold, by a commit that rewrites nothing. persist=False: fold in this session alone; the log goes on naming the segments.
        """
        if persist not in (True, False, "delta"):
            raise ValueError("persist must be True, False or 'delta'")
        before = len(self.state.parts)
        if persist is False:
            tags = [s["tag"] for s in self.state.segments if s["tag"] not in self.stale]
            state = deepcopy(self.state)
            state.apply({"seq": state.seq, "kind": "fold", "base_rows": state.n_rows, "rows_after": state.n_rows, "fold": tags})
            self.state = state
            return {"folded": tags, "parts_before": before, "parts": len(state.parts), "persisted": False}
        tags = self.fold_all()
        if persist == "delta":
            return {"folded": tags, "parts_before": before, "parts": len(self.state.parts), "persisted": bool(tags)}
        before = len(self.state.parts)
        folder, size = self._rewritten(self.state.parts)
        replace = {"parts": [folder], "dead": self._dead_rewritten()}
        if self.state.ledger:
            replace["ledger"] = [_write_ledger(self.store, self.ledger(), self.state.seq + 1)]
        self.state = self.store.commit(self.state, "compact", self.state.n_rows, tier=2, replace=replace, sizes={folder: size})
        log(f"{before} parts rewritten as one")
        return {"folded": tags, "parts_before": before, "parts": 1, "persisted": True}

    def stage_begin(self, tag: str | None = None) -> Stage:
        return Stage(self, tag)

    # directory updates

    def update(self, root: str | None = None, verify: str = "auto", skip_dirs: Iterable[str] = ()) -> dict:
        """Bring the index in line with a directory by the cheapest route; {kind, code, detail, verify, folded}."""
        root = root or self.state.root
        if root is None:
            raise ValueError("no directory is known")
        if verify not in sources.VERIFY:
            raise ValueError(f"verify must be one of {sources.VERIFY}")
        ledger = self.ledger()
        verify = ("stat" if self.state.ledger else "full") if verify == "auto" else verify
        scanned = sources.scan(self.spark, root, skip_dirs, ledger, verify).persist(StorageLevel.MEMORY_AND_DISK)
        texts = _chunk(scanned.where("text is not null")).persist(StorageLevel.MEMORY_AND_DISK)
        indexed = scanned.where("text is null").select("rel", "md5", "size", "mtime_ns").unionByName(scanned.join(texts.select(F.col("file").alias("rel")).distinct(), "rel", "left_semi").select("rel", "md5", "size", "mtime_ns"))
        diff = sources.ledger_diff(ledger, indexed).where("change <> 'unchanged'").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            n = {r["change"]: r["count"] for r in diff.groupBy("change").count().collect()}
            gone = self.chunks().join(diff.where("change <> 'added'").select(F.col("rel").alias("file")), "file", "left_semi").select("row")
            words = texts.select(self.tokenize(F.col("text")).alias("toks"))
            oov = words.select(F.explode_outer("toks").alias("term")).where("term is not null").distinct().join(self.vocabulary(), "term", "left_anti").count() if n else 0
            batch = words.agg(F.coalesce(F.sum(F.size("toks")), F.lit(0))).first()[0] if n else 0
            first = min((s["row_base"] for s in self.state.segments), default=self.state.n_rows)
            tomb = gone.agg(F.count("*").alias("all"), F.count_if(F.col("row") >= first).alias("seg")).first()
            route = route_update(n_added=n.get("added", 0), n_changed=n.get("changed", 0), n_removed=n.get("removed", 0), n_oov=oov, n_tomb_rows=tomb["all"], n_tomb_seg_rows=tomb["seg"], n_segments=len(self.state.segments), n_blocks=len(self._folders()), dense_on=bool(self._views), batch_nnz=batch, total_nnz=self.state.total("nnz", self._folders()), compact_blocks=self.settings["compact_blocks"], rebuild_batch_nnz=self.settings["rebuild_batch_nnz"])
            log(f"update: {route.route} ({route.code}): {route.detail}")
            folded = self.fold_all() if route.folds else []
            kind = route.then if route.folds else route.route
            if kind == "rebuild":
                self.rebuild(root, skip_dirs=skip_dirs)
            elif kind != "noop":
                gone = local_rows(self.spark, gone.collect(), "row long") if tomb["all"] <= 10_000 else gone
                events = indexed.join(diff.where("change <> 'removed'"), "rel", "left_semi").unionByName(diff.where("change = 'removed'").select("rel", *(F.lit(None).cast(t).alias(c) for c, t in (("md5", "string"), ("size", "long"), ("mtime_ns", "long")))))
                actions = {"ledger": [_write_ledger(self.store, events, self.state.seq + 1)], "root": root}
                changed = texts.join(diff.where("change <> 'removed'").select(F.col("rel").alias("file")), "file", "left_semi")
                dead = gone if tomb["all"] else None
                if kind == "staged":
                    self.publish(changed, dead, **actions)
                else:
                    self.append(changed, dead, **actions)
            return {"kind": kind, "code": route.code, "detail": route.detail, "verify": verify, "folded": folded}
        finally:
            for df in (scanned, texts, diff):
                df.unpersist()

    add = update

    def rebuild(self, root: str | None = None, force: bool = False, skip_dirs: Iterable[str] = ()) -> dict:
        """Everything anew from the directory; the parameters stay."""
        if not force:
            self._plain("rebuild")
        root = root or self.state.root
        fresh = Index.build(self.spark, root, self.store.path, skip_dirs, self.tokenize)
        self.state = fresh.state
        return {"kind": "rebuild", "force": force, "files": len(self.files())}

    def reconcile(self) -> DataFrame:
        """(what, key, stored, recomputed): lengths, document and term frequencies of live rows that differ from what their texts give, also in the lexicon; empty if all is well."""
        rows = self.chunks()
        fresh = self._known(counted(rows, tokenize=self.tokenize), rows)
        stored = self.postings()
        a, b = (x.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).select("term", F.concat_ws("/", "df", "tf").alias(n)) for x, n in ((stored, "stored"), (fresh, "recomputed")))
        terms = a.join(b, "term", "full_outer").where(~F.col("stored").eqNullSafe(F.col("recomputed"))).select(F.lit("df/tf").alias("what"), F.col("term").alias("key"), "stored", "recomputed")
        size = F.size(self.tokenize(F.col("text"))).cast("string")
        lengths = rows.select(F.lit("dl").alias("what"), F.col("row").cast("string").alias("key"), F.col("dl").cast("string").alias("stored"), size.alias("recomputed")).where("stored <> recomputed")
        own = stored.groupBy("term").agg(F.count("*").cast("string").alias("recomputed"))
        lex = self.lexicon().where("df <> 0").select("term", F.col("df").cast("string").alias("stored")).join(own, "term", "full_outer").where(~F.col("stored").eqNullSafe(F.col("recomputed")))
        return terms.unionByName(lengths).unionByName(lex.select(F.lit("lexicon").alias("what"), F.col("term").alias("key"), "stored", "recomputed"))

    @staticmethod
    def _known(posts: DataFrame, rows: DataFrame) -> DataFrame:
        """Postings without those of terms that were unknown when their chunk came."""
        unknown = rows.where("unknown is not null").select("row", F.explode("unknown").alias("term"))
        return posts.join(unknown, ["row", "term"], "left_anti") if not unknown.isEmpty() else posts

    # dense views

    def attach_view(self, name: str, vectors: DataFrame, meta: dict | None = None, replace: bool = False) -> dict:
        """A view from (row, vec)."""
        if name in self._views and not replace:
            raise viewing.ViewError(f"view {name} exists")
        view = viewing.attach(vectors, self.all_chunks(), self.dead()).persist(StorageLevel.MEMORY_AND_DISK)
        self._views[name] = {"view": view, "available": True, "meta": dict(meta or {})}
        return self.views()[-1]

    def encode_view(self, name: str, encode: Callable[[list[str]], list[list[float]]], meta: dict | None = None, replace: bool = False) -> dict:
        """A view of all live chunks from an encoder of texts, which the executors call on Arrow batches."""

        def vectors(texts):
            import pandas as pd

            return pd.Series([[float(x) for x in v] for v in encode(texts.tolist())])

        run = series_udf(vectors, "array<float>")
        return self.attach_view(name, cut_lineage(self.chunks().select("row", run("text").alias("vec"))), meta, replace)

    def detach_view(self, name: str) -> bool:
        view = self._views.pop(name, None)
        if view is not None:
            view["view"].unpersist()
        return view is not None

    def drop_view(self, name: str) -> None:
        """Detach a view and delete what `save_view` has written of it."""
        self.detach_view(name)
        self.store.files.delete(f"{self.store.path}/views/{name}")

    def set_view_available(self, name: str, available: bool) -> None:
        self._views[name]["available"] = available

    def views(self) -> list[dict]:
        rows, dead = self.all_chunks(), self.dead()
        return [{"name": n, "available": v["available"], "meta": v["meta"], **viewing.coverage(rows, dead, v["view"]).first().asDict()} for n, v in self._views.items()]

    def covered(self, name: str) -> DataFrame:
        """(row, covered): each live chunk, and whether the view has a vector of it."""
        return viewing.covered(self.chunks(), self._views[name]["view"])

    def fuse(self, query: str, name: str, vector: list[float], k: int = 10, alpha: float = viewing.ALPHA) -> list[dict]:
        """Best k of all live rows by fused score; without the view, or while it is not available, by score."""
        scored = self.chunks().select("row").join(self.scores([query]).select("row", "score"), "row", "left").na.fill(0.0, ["score"])
        view = self._views.get(name)
        if view is None or not view["available"]:
            fused = scored.select("row", F.col("score").alias("base"), F.lit(None).cast("double").alias("cos"), F.col("score").alias("fused"))
        else:
            fused = viewing.fuse(scored, viewing.cosine(view["view"], vector), alpha)
        best = fused.orderBy(F.desc("fused"), "row").limit(max(k, 0)).collect()
        held = self._chunks_of([r["row"] for r in best], ["file", "line", "text"])
        return [{"rank": i + 1, "score": r["fused"], **held[r["row"]]} for i, r in enumerate(best)]

    def search_dense(self, query: str, name: str, vector: list[float], k: int = 10) -> list[dict]:
        best = viewing.dense_rerank(self.scores([query]).select("row", "score"), self._views[name]["view"], vector, k).collect()
        held = self._chunks_of([r["row"] for r in best], ["docid", "file", "line", "text"])
        return [{"rank": i + 1, **r.asDict(), **held[r["row"]]} for i, r in enumerate(best)]

    def save_view(self, name: str) -> str:
        """Write a view by docid: whole under a new name, then put in the old one's place, so that an interrupted save leaves the old one."""
        folder, fresh = f"{self.store.path}/views/{name}", self.store.folder("view")
        self._views[name]["view"].join(self.all_chunks().select("row", "docid"), "row").select("docid", "vec").write.parquet(fresh)
        self.store.files.replace(fresh, folder)
        return folder

    def load_views(self, extra_dirs: Iterable[str] = ()) -> list[dict]:
        """Attach all saved views; a view without a docid in common is reported and left out."""
        out = []
        for base in (f"{self.store.path}/views", *extra_dirs):
            for name in (n for n in self.store.files.names(base) if not n.endswith(".old")):
                rows, unmatched = viewing.by_docid(self.spark.read.parquet(f"{base}/{name}"), self.chunks())
                missing = unmatched.count()
                if rows.isEmpty():
                    out.append({"name": name, "attached": False, "unmatched": missing, "reason": "no docid in common"})
                else:
                    self.attach_view(name, rows, replace=True)
                    out.append({"name": name, "attached": True, "unmatched": missing})
        return out

    def save(self, path: str | None = None, fold_first: bool = False, w_cache: bool = False) -> dict:
        """A full snapshot here, or a copy of the live index elsewhere. Refused under mounted segments unless they are folded first. `w_cache`: with the weights, which later sessions then find."""
        if fold_first:
            self.fold_all()
        self._plain("save")
        if path is None or path.rstrip("/") == self.store.path:
            self.compact()
            saved, scope = self, "snapshot"
        else:
            saved, scope = Index.create(self.spark, path, self.chunks().select("docid", "file", "line", "text"), self.state.k1, self.state.b, self.tokenize), "copy"
        if w_cache:
            saved.settings["w_cache"] = True
            saved.weights()
        return {"path": saved.store.path, "scope": scope, "w_cache": w_cache}

    def history(self) -> list[int]:
        """Commits that can be opened with `upto`."""
        return self.store.log()


class Stage:
    """Rows gathered on the driver or as DataFrames, to be published in one commit."""

    def __init__(self, index: Index, tag: str | None = None):
        self.index, self.tag, self.parts, self.n, self.open = index, tag, [], 0, True

    def _check(self) -> None:
        if not self.open:
            raise RuntimeError("this stage is closed")

    def add(self, docid: str, text: str, file: str = "", line: int = 1) -> None:
        self.add_many([(docid, file, line, text)])

    def add_many(self, rows) -> None:
        """Tuples (docid, file, line, text), or a DataFrame with these columns."""
        self._check()
        if not isinstance(rows, DataFrame):
            rows = list(rows)
            self.n += len(rows)
            rows = local_rows(self.index.spark, rows, "docid string, file string, line int, text string") if rows else None
        else:
            self.n += rows.count()
        if rows is not None:
            self.parts.append(rows.select("docid", "file", "line", "text"))

    def pending(self) -> int:
        return self.n

    def report(self) -> dict:
        return {"open": self.open, "pending": self.n, "tag": self.tag}

    def abort(self) -> None:
        self.parts, self.n, self.open = [], 0, False

    def publish(self, fold: bool = False) -> dict:
        self._check()
        if not self.n:
            raise RuntimeError("nothing is staged")
        rows = self.parts[0]
        for p in self.parts[1:]:
            rows = rows.unionByName(p)
        info = self.index.publish(rows, tag=self.tag)
        self.open = False
        if fold:
            self.index.fold(info["tag"])
        return info | {"folded": fold}


def _chunk(scanned: DataFrame) -> DataFrame:
    """(docid, file, line, text) of scanned files; a docid is the beginning of the file's hash and the chunk's number."""
    # the hash goes along as part of the key: a join by file would move all texts once they are many
    made = chunking.chunk_files(scanned.where("text is not null").select(F.struct("rel", "md5").alias("file"), "text"), name="file.rel")
    return made.select(F.concat_ws(":", F.substring("file.md5", 1, 8), "seq").alias("docid"), F.col("file.rel").alias("file"), "line", "text")


def _by_term(table: DataFrame, rows: int, *order: str) -> DataFrame:
    """Rows in files that hold ranges of terms, so that a scan for a few terms skips the rest; a common term is spread over files by row. One file for few documents."""
    order = order or ("term", "row")
    return (table.repartitionByRange(*order) if rows > SMALL else table.coalesce(1)).sortWithinPartitions(*order)


def _write_part(store: Store, texts: DataFrame, base: int, tokenize, vocabulary: Callable[[], DataFrame] | None = None) -> tuple[str, dict]:
    """Number, tokenise and write rows; folder, and its rows, tokens (dl) and postings (nnz). With a vocabulary other terms get no posting and are kept as the chunk's unknown ones."""
    folder, spark = store.folder("part"), store.spark
    rows, n = numbered(texts.select("docid", "file", F.col("line").cast("int").alias("line"), "text"), ["file", "line", "docid"], base)
    toks = tokenize(as_column("text"))
    none = F.lit(None).cast("array<string>")
    measured = rows.select("row", "docid", "file", "line", "text", F.size(toks).cast("long").alias("dl"))
    if vocabulary is None:
        measured = measured.withColumn("unknown", none)
    else:
        words = rows.select("row", F.explode_outer(F.array_distinct(toks)).alias("term")).where("term is not null")
        new = cut_lineage(words.join(words.select("term").distinct().join(vocabulary(), "term", "left_anti"), "term", "left_semi").groupBy("row").agg(F.collect_list("term").alias("unknown")))  # words of one document
        measured = measured.join(new, "row", "left")
    (measured if n > SMALL else measured.coalesce(1)).write.parquet(f"{folder}/chunks")
    written = spark.read.schema(CHUNKS).parquet(f"{folder}/chunks")
    posts = counted(written, tokenize=tokenize)  # a task's documents are few enough; each file has all terms, by term, and a scan for a few skips the rest by its pages
    if vocabulary is not None:
        known = written.where("unknown is not null").select("row", F.explode("unknown").alias("term"))
        posts = posts.join(known, ["row", "term"], "left_anti")
    posts = posts.select("row", "dl", "term", "tf")
    (posts if n > SMALL else posts.coalesce(1).sortWithinPartitions("term", "row")).write.parquet(f"{folder}/postings")
    stored = spark.read.schema(POSTINGS).parquet(f"{folder}/postings")
    _by_term(lexicon(stored), n, "term").write.parquet(f"{folder}/lexicon")
    nnz = stored.count()  # from the files' footers
    return folder, {"rows": n, "dl": written.agg(F.coalesce(F.sum("dl"), F.lit(0))).first()[0], "nnz": nnz}


def _write_ledger(store: Store, events: DataFrame, seq: int) -> str:
    folder = store.folder("ledger")
    events.select(F.lit(seq).cast("long").alias("seq"), "rel", "md5", "size", "mtime_ns").write.parquet(f"{folder}/ledger")
    return folder


def open_index(spark: SparkSession, path: str, upto: int | None = None) -> Index:
    return Index(spark, path, upto)


def build_index(spark: SparkSession, root: str, path: str, **options) -> Index:
    return Index.build(spark, root, path, **options)


__all__ = ["Index", "Stage", "Snapshot", "Route", "build_index", "open_index"]
