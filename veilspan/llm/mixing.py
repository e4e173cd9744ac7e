"""Operator 8: mix sources to target weights.

Documents of a source are laid end to end and cut into blocks of
``BLOCK_WORDS`` words. The mixture is a list of output shards of
``SHARD_SLOTS`` slots, each slot one block. Every slot draws its source by a
hashed uniform against the cumulative targets, so a shard's counts of sources
are multinomial. A source's target is also its quota of slots: slots drawn
beyond it, which are about the square root of all, are reshared to the sources
that fell short. A source's slots, numbered through all shards, walk its blocks
in passes; each pass visits the blocks by a pseudorandom permutation of their
indexes (x -> (a x + b) mod n, a prime that does not divide n). Blocks and slots
meet by (source, block), keys that are spread evenly however large a source is.

Everything is DataFrame expressions. Slots come from a range that Spark cuts,
and prefix sums (over a source's documents, over shards) are taken in two steps,
chunks of bounded size and then the chunks, so no window and no task holds a
source. What is held whole is a few numbers for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, join_per_key, saved, table, uniform

#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: No source is repeated more often than this.
MAX_EPOCHS = 3
BLOCK_WORDS = 64
SHARD_SLOTS = 4096
#: Rows of a prefix-sum chunk, about.
CHUNK_ROWS = 5_000
#: Shards of a prefix-sum chunk.
CHUNK_SHARDS = 64
#: Slots of a partition of the draw, about.
DRAWN_SLOTS = 1 << 20
#: Primes for the permutations: their product exceeds any index, so one of them does not divide n.
PRIMES = (1_000_003, 1_000_033, 1_000_037, 1_000_039, 1_000_081, 1_000_099, 1_000_117, 1_000_121, 1_000_133, 1_000_151)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target, m): weights share the total; a target stops at ``max_epochs`` times its source's size and the excess goes to the others by weight.

    Resharing until no target is above its cap is filling to one level: target
    = min(weight * level, cap). Sources sorted by cap / weight give the level in
    closed form: the first source that the level of the rest does not cap (later
    sources would give lower levels). The ordering windows see one row a source.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("m"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = per_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)))
    capped = weighed.withColumn("cap", F.col("source_size") * float(max_epochs))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    levelled = capped.withColumn("level", level).withColumn("final", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("final"), F.col("cap")))
    return levelled.select("source", "source_size", target.alias("target"), "m")


def document_offsets(sized: DataFrame, n_rows: int) -> DataFrame:
    """Adds ``start``: the words of the same source before the document, in an order by hash."""
    chunks = max(1, n_rows // CHUNK_ROWS)
    chunked = sized.withColumn("chunk", F.pmod(F.xxhash64("row.doc_id", "row.content"), F.lit(chunks)))
    inside = Window.partitionBy("source", "chunk").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    tops = chunked.groupBy("source", "chunk").agg(F.sum("size").alias("words")).select("source", "chunk", F.coalesce(F.sum("words").over(above), F.lit(0)).alias("top"))
    local = chunked.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = local.alias("d").join(tops.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("d.chunk") == F.col("t.chunk")))
    return joined.select("d.*", (F.col("d.local") + F.col("t.top")).alias("start")).drop("chunk", "local")


def source_quotas(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row of arrays over the sources in order (null last): ``name, n`` (blocks), ``quota`` (slots), ``upto`` (quotas summed)."""
    n = F.ceil(F.col("source_size") / block_words).cast("long")
    per = targets.where("source_size > 0").select(F.col("source").isNull().alias("none"), F.col("source").alias("name"), n.alias("n"), F.round(F.col("target") * n / F.col("source_size")).cast("long").alias("quota"))
    summed = per.withColumn("upto", F.sum("quota").over(Window.orderBy("none", "name")))  # one row a source
    return summed.agg(F.array_sort(F.collect_list(F.struct("none", "name", "n", "quota", "upto"))).alias("s")).select("s.name", "s.n", "s.quota", "s.upto")


def _first_above(sums: Column, value: Column, steps: int) -> Column:
    """The first index of ascending ``sums`` above ``value``, by halving."""
    middle = lambda a: F.floor((a["lo"] + a["hi"]) / 2).cast("int")
    # the array travels in the accumulator, so a lambda holds no subquery
    halve = lambda a, _: F.when(F.get(a["sums"], middle(a)) > value, F.struct(a["lo"].alias("lo"), middle(a).alias("hi"), a["sums"].alias("sums"))).otherwise(F.struct((middle(a) + 1).alias("lo"), a["hi"].alias("hi"), a["sums"].alias("sums")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("lo"), (F.size(sums) - 1).alias("hi"), sums.alias("sums")), halve)["lo"]


def _upto(rows: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the group's earlier shards, by chunks of shards."""
    chunked = rows.withColumn("chunk", F.floor(F.col("shard") / CHUNK_SHARDS).cast("long"))
    keys = [*group, "chunk"]
    above = Window.partitionBy(*group).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    tops = chunked.groupBy(*keys).agg(F.sum(value).alias("_t")).select(*keys, F.coalesce(F.sum("_t").over(above), F.lit(0)).alias("_top"))
    return chunked.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(tops, keys).withColumn(out, F.col("_local") + F.col("_top")).drop("chunk", "_local", "_top")


def draw_counts(quotas: DataFrame, n_slots: int, n_sources: int, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """(shard, k, slots): how many slots of each output shard draw the k-th source: multinomial counts by the quotas' shares."""
    steps = max(1, n_sources.bit_length())
    spark = quotas.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-n_slots // DRAWN_SLOTS))
    value = F.floor(uniform(F.lit(seed), F.col("id")) * n_slots)
    # upto's last entry is n_slots, which no value reaches
    drawn = spark.range(0, n_slots, 1, parts).withColumn("upto", quotas.select("upto").scalar()).select(F.floor(F.col("id") / shard_slots).cast("long").alias("shard"), _first_above(F.col("upto"), value, steps).alias("k"))
    return drawn.groupBy("shard", "k").agg(F.count(F.lit(1)).alias("slots"))


def draw_slots(targets: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """(source, n, shard, t): every slot with its source, the source's number of blocks, and the slot's number among the source's.

    ``t`` runs from 0 to the source's quota. A quota is the target in blocks, so it stops at the most passes.
    """
    quotas = saved(source_quotas(targets, block_words))
    n_sources, n_slots = quotas.select(F.size("upto"), F.coalesce(F.array_max("upto"), F.lit(0))).first()
    drawn = saved(draw_counts(quotas, n_slots, n_sources, shard_slots, seed))
    of = lambda name: F.get(quotas.select(name).scalar(), F.col("k"))
    numbered = _upto(drawn, ["k"], "slots", "first").withColumn("kept", F.greatest(F.least(F.col("slots"), of("quota") - F.col("first")), F.lit(0)))
    numbered = saved(numbered.withColumn("over", F.col("slots") - F.col("kept")))
    # a number, because small rows that are about to grow must not be put together
    parts = max(targets.sparkSession.sparkContext.defaultParallelism, -(-n_slots // DRAWN_SLOTS))
    regular = numbered.where("kept > 0").repartition(parts, "k", "shard").select("k", "shard", F.explode(F.sequence("first", F.col("first") + F.col("kept") - 1)).alias("t"))
    # slots over quota, numbered through all shards, fill the shortfalls in order of source
    got = drawn.groupBy("k").agg(F.sum("slots").alias("got"))
    missing = quotas.select(F.posexplode("quota").alias("k", "quota")).join(got, "k", "left").select("k", F.greatest(F.col("quota") - F.coalesce("got", F.lit(0)), F.lit(0)).alias("missing"))
    ends = missing.select("k", F.sum("missing").over(Window.orderBy("k")).alias("end")).agg(F.array_sort(F.collect_list(F.struct("k", "end"))).alias("e")).select(F.col("e.end").alias("ends"))
    missing = saved(ends)
    spare = _upto(numbered.groupBy("shard").agg(F.sum("over").alias("over")).withColumn("all", F.lit(0)), ["all"], "over", "before").where("over > 0")
    spare = spare.select("shard", F.explode(F.sequence("before", F.col("before") + F.col("over") - 1)).alias("x")).withColumn("ends", missing.select("ends").scalar())
    given = spare.withColumn("k", _first_above(F.col("ends"), F.col("x"), max(1, n_sources.bit_length()))).select("k", "shard", (of("quota") - F.get("ends", F.col("k")) + F.col("x")).alias("t"))
    return regular.unionByName(given).select(of("name").alias("source"), of("n").alias("n"), "shard", "t")


def block_uses(slots: DataFrame, seed: int = 0) -> DataFrame:
    """(source, block, shard, pass): the block that every slot (source, n, shard, t) shows."""
    numbered = slots.withColumn("pass", F.floor(F.col("t") / F.col("n")).cast("long")).withColumn("x", F.col("t") - F.col("pass") * F.col("n"))
    primes = F.array(*[F.lit(p).cast("long") for p in PRIMES])
    shift = F.pmod(F.xxhash64(F.lit(seed), F.col("source"), F.col("pass")), F.col("n"))
    # the pass picks where the list of primes starts, so each pass has its own stride
    turned = F.concat(F.slice(primes, F.pmod(F.col("pass"), F.lit(len(PRIMES) // 2)).cast("int") + 1, len(PRIMES)), primes)
    numbered = numbered.withColumn("a", F.element_at(F.filter(turned, lambda p: F.col("n") % p != 0), 1))
    return numbered.select("source", "shard", "pass", F.pmod(F.pmod(F.col("a"), F.col("n")) * F.col("x") + shift, F.col("n")).alias("block"))


def document_pieces(placed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each block that a document lies in: the words [piece_from, piece_from + words) of it."""
    last = F.floor((F.col("start") + F.col("size") - 1) / block_words).cast("long")
    spread = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words).cast("long"), last)))
    begin = F.greatest(F.col("block") * block_words, F.col("start"))
    end = F.least((F.col("block") + 1) * block_words, F.col("start") + F.col("size"))
    return spread.withColumn("piece_from", begin - F.col("start")).withColumn("words", end - begin)


def mix(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mixes (doc_id, source, text) documents.

    ``row`` numbers them by (doc_id, content); rows equal in all of that are
    told apart by a number, and which gets which makes no difference. Returns
    three tables: documents with ``row, source, size, start``; targets
    with ``source, source_size, target, m`` (documents); and the mixture, a row for each slot
    and each document piece in its block: ``shard, pass, row, piece_from,
    words``. Null texts have size 0 and lie in no block; a null source is a
    source of its own, last in order. An empty table, or one without words,
    gives an empty mixture. The same input and seed give the same mixture.
    Very long texts are cut like others; other columns play no part.
    """
    row = F.struct("doc_id", F.xxhash64("source", "text").alias("content"), F.monotonically_increasing_id().alias("n"))
    sized = saved(docs.select(row.alias("row"), "source", word_count(F.col("text")).alias("size")))
    n_rows = sized.count()
    targets = saved(source_targets(sized, weights, max_epochs))
    placed = saved(document_offsets(sized, n_rows))
    uses = block_uses(draw_slots(targets, block_words, shard_slots, seed), seed)
    pieces = document_pieces(placed, block_words)
    met = uses.alias("u").join(pieces.alias("p"), (F.col("u.block") == F.col("p.block")) & F.col("u.source").eqNullSafe(F.col("p.source")))
    mixture = met.select("u.shard", "u.pass", "p.row", "p.source", "p.piece_from", "p.words")
    return placed, targets, mixture


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture as documents: a row for each pass over a document, its ``text`` the words that the pass takes.

    The pieces that a pass takes keep their own white space; a pass over all of
    a document gives its text unchanged (without outer white space). All columns
    of ``docs`` stay, as does one row per pass; documents that no slot shows go.
    """
    placed, _, mixture = mix(docs, **options)
    takes = mixture.groupBy("row", "source", "pass").agg(F.array_sort(F.collect_list(F.struct("piece_from", "words"))).alias("_pieces"), F.sum("words").alias("_words"))
    # equal rows are told apart by their number among equals, on both sides
    among = Window.partitionBy("row.doc_id", "row.content").orderBy("row.n")
    numbers = placed.where("size > 0").select("row", "size", F.row_number().over(among).alias("nth"))
    key = lambda doc_id, content: [doc_id.isNull().alias("_none"), F.coalesce(doc_id, F.lit(0)).alias("_id"), content.alias("_content")]
    names = ["_none", "_id", "_content"]
    takes = takes.join(numbers, "row").select(*key(F.col("row.doc_id"), F.col("row.content")), F.col("nth").alias("_nth"), "_pieces", (F.col("_words") == F.col("size")).alias("_all"))
    # the input's columns travel as one struct, so that none can clash
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *key(F.col("doc_id"), F.xxhash64("source", "text")))
    keyed = keyed.withColumn("_nth", F.row_number().over(Window.partitionBy(*names).orderBy(*names)))
    # equal rows meet one take each: their number is a key, and texts that were dealt for it by the other keys stay where they are
    met = keyed.join(takes, [*names, "_nth"])
    # each word with the white space after it, so that slices of the array are stretches of the text
    tokens = F.regexp_extract_all(F.col("_doc.text"), F.lit(WORD + r"[\x20\x09-\x0D]*+"), F.lit(0))
    cut = lambda words: F.array_join(F.transform("_pieces", lambda p: F.array_join(F.slice(words, (p["piece_from"] + 1).cast("int"), p["words"].cast("int")), "")), "")
    # bound as a lambda's argument, so that a text is split once and not for each piece
    taken = F.get(F.transform(F.array(tokens), cut), 0)
    text = F.btrim(F.when(F.col("_all"), F.col("_doc.text")).otherwise(taken), F.lit(SPACE))
    return met.select(F.col("_doc").withField("text", text).alias("_doc")).select("_doc.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, targets, mixture = mix(table(spark, sf_dir, "documents"))
    taken = mixture.groupBy("row").agg(F.sum("words").alias("taken"))
    # a null source needs a name of its own to be joined by equality
    named = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_source")
    out = placed.select("row", "size", named).alias("d").join(taken.alias("t"), F.col("d.row") == F.col("t.row"), "left").select("d.row", "size", "_source", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    met = join_per_key(out, targets.select(named, "source_size", "target", "m"), "_source", placed.count())
    return met.select("row.doc_id", "size", "source_size", "target", "taken")
