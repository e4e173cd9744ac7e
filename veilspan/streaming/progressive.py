"""Page-by-page processing as a stream: detect, apply rules, propagate from earlier pages, append.

Pages arrive in page order, one or more of a document in a batch. Each micro-batch is one step of ``foreachBatch``:
its spans go to a table under the batch's number, so a batch that is run again
after a failure overwrites its own rows and nothing else. The checkpoint is the
place to resume from; rules are read anew for every batch.

Where asked to, the stream saves a draft of a document with every tenth of its pages: one row a document, the newest
draft in place of the one before (a keyed table, so that a batch reads and writes only the files of its own documents).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import keyed, rewrites
from ..operators.page_steps import BROUGHT, stepper
from ..operators.propagate import DECAY, as_it_is, propagate, propagate_to_page
from ..operators.rules import apply_decisions

STEP = "doc_id bigint, page_index int, label string, text string, norm_text string, confidence double, source string, char_start int, char_end int"
_FIELDS = [f.split(" ")[0] for f in STEP.split(", ")]
#: So many rules at most travel to the executors whole; people write them.
MOST_RULES = 200_000


def numbered(spans: DataFrame) -> DataFrame:
    """Spans with ``ord`` in page order."""
    from ..operators.detect import with_order

    return with_order(spans, "page_index", "char_start", "char_end", "label")


def stored(spark: SparkSession, folder: str) -> Callable[[DataFrame, str], DataFrame]:
    """Writes a step's intermediate table in the folder, in place of the last one of its name, and reads it again."""

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    return keep


def process_step(new_pages: DataFrame, earlier: DataFrame, rules: DataFrame, detector: Callable[[DataFrame], DataFrame], *, flexible: bool = True, keep: Callable[[DataFrame, str], DataFrame] = as_it_is) -> DataFrame:
    """The spans of new pages, at most one of a document: detected ones after the rules, and those that the texts of earlier pages of their documents bring.

    ``keep`` is given what is used several times (by name), so that it can be computed once.
    """
    rules = keep(rules, "rules")
    own = keep(apply_decisions(detector(new_pages), rules).select(*_FIELDS), "own")
    # a document's spans matter to its own pages only: work follows the batch, not the stream's length
    earlier = earlier.select(*_FIELDS).join(new_pages.select("doc_id").distinct(), "doc_id", "left_semi")
    known = numbered(earlier.select(*_FIELDS).unionByName(own))
    brought = propagate_to_page(known, new_pages, rules, flexible=flexible, keep=keep)
    return own.unionByName(brought.select(*_FIELDS))


def _page_by_page(new_pages: DataFrame, earlier: DataFrame, rules: DataFrame, detector: Callable[[DataFrame], DataFrame], flexible: bool, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``process_step`` for each page index of a batch, in order (pages without one first): rules of any number are joined."""
    indexes = sorted((r[0] for r in new_pages.select("page_index").distinct().collect()), key=lambda i: (i is not None, i))
    found = new_pages.sparkSession.createDataFrame([], STEP)
    for n, index in enumerate(indexes):
        pages = new_pages.where(F.col("page_index").eqNullSafe(index))
        step = keep(process_step(pages, earlier.select(*_FIELDS).unionByName(found), rules, detector, flexible=flexible, keep=lambda df, name, n=n: keep(df, f"{name}-{n}")), f"page-{n}")
        found = found.unionByName(step)
    return found


def process_pages(new_pages: DataFrame, earlier: DataFrame, rules: DataFrame, detector: Callable[[DataFrame], DataFrame], *, flexible: bool = True, keep: Callable[[DataFrame, str], DataFrame] = as_it_is, most_rules: int = MOST_RULES) -> DataFrame:
    """The spans of new pages, any number of a document, as if each came in a batch of its own in order of its index.

    A document's pages, spans so far and own spans meet in one row, where its pages are worked off one after the other
    (``page_steps``), so that a batch costs the same number of jobs whatever number of pages its longest document has. Up to ``most_rules`` rules, counted, travel whole; with more, pages are
    joined with them index by index, with the same result.
    """
    spark = new_pages.sparkSession
    rules = keep(rules, "rules")
    held = rules.where("kind in ('suppress', 'override') and norm_text is not null").select("kind", "norm_text", "label").limit(most_rules + 1).collect()
    if len(held) > most_rules:
        return _page_by_page(new_pages, earlier, rules, detector, flexible, keep)
    labels: dict[str, list[str | None]] = {}
    for r in held:
        if r.kind == "override":
            labels.setdefault(r.norm_text, []).append(r.label)
    known = spark.sparkContext.broadcast((frozenset(r.norm_text for r in held if r.kind == "suppress"), labels))  # at most ``most_rules``
    own = keep(apply_decisions(detector(new_pages), rules).select(*_FIELDS), "own")
    fields = _FIELDS[1:]
    before = earlier.select(*_FIELDS).join(new_pages.select("doc_id").distinct(), "doc_id", "left_semi")
    spans = before.withColumn("fresh", F.lit(False)).unionByName(own.withColumn("fresh", F.lit(True))).where("doc_id is not null").select("doc_id", F.struct(*fields, "fresh").alias("span"))
    pages = new_pages.where("doc_id is not null and page_index is not null").select("doc_id", F.struct("page_index", "text").alias("page"))
    # lists pass over what is missing
    met = pages.unionByName(spans, allowMissingColumns=True).groupBy("doc_id").agg(F.collect_list("page").alias("pages"), F.collect_list("span").alias("spans"))
    step = F.arrow_udf(f"array<{BROUGHT}>")(stepper(lambda: known.value, flexible, DECAY))
    brought = met.where("size(pages) > 0 and size(spans) > 0").select("doc_id", F.inline(step("pages", "spans")))
    return own.unionByName(brought.select(*_FIELDS))


#: A draft is saved with each so many pages, in a table of so many buckets.
EVERY = 10
BUCKETS = 64
_DRAFT = ("page_index", "label", "text", "char_start", "char_end")


def drafts_of(batch: DataFrame, spans: DataFrame, every: int = EVERY) -> DataFrame:
    """Drafts of the documents of which the batch has an ``every``-th page: (doc_id, page_count, entity_count, entities_json).

    A draft holds the spans so far on the pages up to that one, in page order; a document without any has an empty list.
    A batch with several such pages of a document gives the last one's draft.
    """
    due = batch.where((F.col("page_index") + 1) % every == 0).groupBy("doc_id").agg((F.max("page_index") + 1).alias("page_count"))
    held = spans.select("doc_id", F.struct(*_DRAFT).alias("s"))
    met = due.join(held, "doc_id", "left").groupBy("doc_id", "page_count").agg(F.array_sort(F.collect_list(F.when(F.col("s.page_index") < F.col("page_count"), F.col("s")))).alias("e"))
    return met.select("doc_id", "page_count", F.size("e").cast("long").alias("entity_count"), F.to_json("e").alias("entities_json"))


def save_drafts(found: DataFrame, path: str) -> None:
    """Puts drafts in the place of earlier ones of their documents; those of fewer pages than the saved ones are left out."""
    if rewrites.versions(found.sparkSession, path):
        keyed.upsert(found, path)
    else:
        keyed.create(found, path, ["doc_id"], "page_count", BUCKETS)


def start(pages: DataFrame, out: str, checkpoint: str, detector: Callable[[DataFrame], DataFrame], rules: Callable[[], DataFrame], *, drafts: str | None = None, every: int = EVERY):
    """Starts the stream; spans are written to ``out/batch=n`` and drafts, if a path is given, to that keyed table. Returns the query."""
    spark = pages.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        earlier = spark.read.schema(STEP + ", batch int").parquet(out).where(F.col("batch") < number) if number else spark.createDataFrame([], STEP)
        # a folder that readers of ``out`` pass over; a batch that runs again writes its tables again
        found = process_pages(batch, earlier, rules(), detector, keep=stored(spark, f"{out}/_step"))
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if drafts and not batch.where((F.col("page_index") + 1) % every == 0).isEmpty():
            so_far = spark.read.schema(STEP + ", batch int").parquet(out).where(F.col("batch") <= number)
            save_drafts(drafts_of(batch, so_far, every), drafts)

    return pages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def close(spark: SparkSession, pages: DataFrame, out: str, *, flexible: bool = True) -> DataFrame:
    """All spans of the stream, and those that the full pass over all pages adds."""
    spans = numbered(spark.read.schema(STEP + ", batch int").parquet(out).select(*_FIELDS))
    return spans.select(*_FIELDS).unionByName(propagate(spans, pages, flexible=flexible, keep=stored(spark, f"{out}/_close")).select(*_FIELDS))


def page_status(pages: DataFrame, spans: DataFrame, failed: DataFrame) -> DataFrame:
    """ready, error or pending for each page."""
    done = spans.select("doc_id", "page_index").distinct().withColumn("_done", F.lit(True))
    bad = failed.select("doc_id", "page_index").distinct().withColumn("_bad", F.lit(True))
    met = pages.select("doc_id", "page_index").join(done, ["doc_id", "page_index"], "left").join(bad, ["doc_id", "page_index"], "left")
    return met.select("doc_id", "page_index", F.when(F.col("_bad"), "error").when(F.col("_done"), "ready").otherwise("pending").alias("status"))
