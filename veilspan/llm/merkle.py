"""Operator 11: Merkle dataset manifest with a block engine of DuckDB.

Spark hashes every row into a leaf where it is read and numbers the leaves of each
source in id order; texts never move. A source's tree is cut into
aligned buckets of ``FANOUT ** BLOCK_LEVELS`` consecutive leaves, so that a bucket
is a subtree. Buckets reach the executors as Arrow groups, and DuckDB
runs one query a level over them there: ``string_agg`` in order of the nodes of a run,
then ``sha256``. The buckets' roots are the leaves of the next tier, which is
built in the same way until one node is left; the sources' roots then form a tree of
their own. On the way down each tier's proofs (siblings to the left and to the right, a
level each) are joined with the proofs of the tier above; the leaves finally meet
their bucket's outer proof in a cogroup, in which DuckDB folds them to the root.

A bucket's size is fixed and small sources share a group, so a hot source is many groups.
A bucket but the first of its source always climbs all its levels; the first
stops at one node, which in a bucket that is not full is the whole tree's.
"""

from __future__ import annotations

from collections.abc import Callable

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_per_key, saved, sha256_hex, table

FANOUT = 3
#: Levels of a bucket: 3^8 = 6,561 leaves.
BLOCK_LEVELS = 8
#: What DuckDB may hold in one Python worker.
BLOCK_MEMORY = "600MB"
_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(text: Column) -> Column:
    """The leaf of a row whose text is ``text``."""
    return sha256_hex(F.concat(*[_field(text if c == "text" else F.col(c).cast("string")) for c in _FIELDS]))


def tampered(text: Column) -> Column:
    """The text without its line feeds where 2 divides the id's checksum; else as it is."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(hit, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def numbered(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """Adds ``pos``, each row's place from 0 in its ``tree`` (a string, not null) by ``order`` (nulls first).

    The rows are sorted into ranges and stored; a range's rows are counted by tree, and only
    a tree that crosses ranges needs to know what came before, which is at most
    two rows a range, whatever the number of trees: those are broadcast.
    """
    ranges = saved(rows.repartitionByRange(tree, *[F.asc_nulls_first(c) for c in order]).withColumn("range", F.spark_partition_id()))
    counts = ranges.groupBy("range", tree).agg(F.count(F.lit(1)).alias("n"))
    ends = counts.groupBy("range").agg(F.min(tree).alias("lo"), F.max(tree).alias("hi"))
    edges = counts.join(ends, "range").where((F.col(tree) == F.col("lo")) | (F.col(tree) == F.col("hi")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(tree).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = saved(edges.select("range", tree, before.alias("before")).where("before > 0"))
    within = F.row_number().over(Window.partitionBy("range", tree).orderBy(*[F.asc_nulls_first(c) for c in order]))
    placed = ranges.withColumn("within", within).join(F.broadcast(offsets), ["range", tree], "left")
    return placed.withColumn("pos", F.col("within") - 1 + F.coalesce("before", F.lit(0))).drop("range", "within", "before")


def _connection(**tables: pa.Table) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"threads": 1, "memory_limit": BLOCK_MEMORY, "temp_directory": ""})
    for name, rows in tables.items():
        con.register(name, rows)
    return con


def _levels(con: duckdb.DuckDBPyConnection, levels: int, fanout: int, *, paths: bool) -> None:
    """Climbs the nodes (tree, bucket, idx, digest) of table ``node`` level by level; ``idx`` counts within the bucket.

    With ``paths``, table ``step`` gets for every level the siblings to the left and to the right of
    each node (tree, bucket, idx, level, lft, rgt). A tree's only bucket stops at one node.
    """
    con.sql("create temp table open as select tree, bucket, bucket > 0 or count(*) > 1 as climbs from node group by tree, bucket")
    for level in range(levels):
        if paths:
            order = f"partition by tree, bucket, idx // {fanout} order by idx"
            con.sql(
                f"""insert into step select tree, bucket, idx, {level},
                  coalesce(string_agg(digest, '') over ({order} rows between unbounded preceding and 1 preceding), ''),
                  coalesce(string_agg(digest, '') over ({order} rows between 1 following and unbounded following), '')
                from node semi join (from open where climbs) using (tree, bucket)"""
            )
        con.sql(
            f"""create or replace temp table node as
              select tree, bucket, idx // {fanout} as idx, sha256(string_agg(digest, '' order by idx)) as digest
              from node semi join (from open where climbs) using (tree, bucket) group by tree, bucket, idx // {fanout}
              union all select tree, bucket, idx, digest from node anti join (from open where climbs) using (tree, bucket)"""
        )
        con.sql("create or replace temp table open as select tree, bucket, bucket > 0 or count(*) > 1 as climbs from node group by tree, bucket")


def _roots(nodes: pa.Table, levels: int, fanout: int) -> pa.Table:
    """The root of every bucket of a group: (tree, pos, digest), places in the next tier."""
    with _connection(given=nodes) as con:
        con.sql(f"create temp table node as select tree, pos // {fanout**levels} as bucket, pos % {fanout**levels} as idx, digest from given")
        _levels(con, levels, fanout, paths=False)
        return con.sql("select tree, bucket as pos, digest from node").to_arrow_table()


def _paths(nodes: pa.Table, levels: int, fanout: int) -> pa.Table:
    """The siblings of every node of a group within its bucket, a level each: (tree, pos, lft, rgt)."""
    with _connection(given=nodes) as con:
        _with_steps(con, levels, fanout)
        power = " ".join(f"when {k} then {fanout**k}" for k in range(levels))
        return con.sql(
            f"""select tree, pos, list(lft order by level) as lft, list(rgt order by level) as rgt
            from (select tree, pos, pos // {fanout**levels} as bucket, pos % {fanout**levels} as place, level, place // (case level {power} end) as idx from given, (select unnest(range({levels})) as level))
            join step using (tree, bucket, level, idx) group by tree, pos
            union all select tree, pos, [], [] from given where not exists (from step where step.tree = given.tree and step.bucket = pos // {fanout**levels})"""
        ).to_arrow_table()


def _with_steps(con: duckdb.DuckDBPyConnection, levels: int, fanout: int) -> None:
    con.sql(f"create temp table node as select tree, pos // {fanout**levels} as bucket, pos % {fanout**levels} as idx, digest from given")
    con.sql("create temp table step (tree varchar, bucket bigint, idx bigint, level int, lft varchar, rgt varchar)")
    _levels(con, levels, fanout, paths=True)


def _fold(leaves: pa.Table, outer: pa.Table, levels: int, fanout: int) -> pa.Table:
    """Every leaf of a group folded with its siblings, those of its bucket first, then the outer ones."""
    with _connection(given=leaves, outside=outer) as con:
        _with_steps(con, levels, fanout)
        con.sql(f"create temp table folded as select tree, pos, pos // {fanout**levels} as bucket, pos % {fanout**levels} as place, doc_id, digest, other as folded, '' as siblings from given")
        step = "create or replace temp table folded as select f.* replace (if(lft is null, folded, sha256(lft || folded || rgt)) as folded, if(lft is null, siblings, siblings || lft || rgt) as siblings) from folded f left join now s on f.tree = s.tree and f.bucket = s.bucket"
        for level in range(levels):
            con.sql(f"create or replace temp table now as select tree, bucket, idx, lft, rgt from step where level = {level}")
            con.sql(f"{step} and f.place // {fanout**level} = s.idx")
        for level in range(1, 1 + con.sql("select coalesce(max(len(lft)), 0) from outside").fetchall()[0][0]):
            con.sql(f"create or replace temp table now as select tree, pos as bucket, lft[{level}] as lft, rgt[{level}] as rgt from outside where len(lft) >= {level}")
            con.sql(step)
        return con.sql(
            """select doc_id, digest as leaf, subroot, root, sha256(siblings) as proof_sha256, folded as folded_root, folded = root as verified
            from folded join outside on folded.tree = outside.tree and folded.bucket = outside.pos"""
        ).to_arrow_table()


def _per_group(run: Callable[[pa.Table, int, int], pa.Table], levels: int, fanout: int) -> Callable[[pa.Table], pa.Table]:
    def of_group(nodes: pa.Table) -> pa.Table:
        return run(nodes, levels, fanout)

    return of_group


def _grouped(nodes: DataFrame, groups: int, place: Column) -> DataFrame:
    """Nodes with the number of the group that their bucket falls in; a group holds whole buckets."""
    return nodes.withColumn("block", F.pmod(F.xxhash64("tree", place), F.lit(groups)))


_ROOT, _PATH = "tree string, pos long, digest string", "tree string, pos long, lft array<string>, rgt array<string>"


def climb(leaves: DataFrame, levels: int, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """All tiers (tree, pos, digest) above the leaves, each the bucket roots of the one below, and the roots (tree, digest)."""
    tiers, size = [], fanout**levels
    nodes = leaves
    while True:
        n = nodes.count()
        nodes = saved(_grouped(nodes.select("tree", "pos", "digest"), n // size + 1, F.floor(F.col("pos") / size)).groupBy("block").applyInArrow(_per_group(_roots, levels, fanout), _ROOT))
        tiers.append(nodes)
        if not (nodes.agg(F.max("pos")).first()[0] or 0):
            return tiers, nodes.select("tree", "digest")


def paths(tiers: list[DataFrame], levels: int, fanout: int) -> DataFrame:
    """(tree, pos, lft, rgt): for each node of the first tier its siblings on the way to the tree's root, a level each."""
    size, above = fanout**levels, None
    for nodes in reversed(tiers):
        own = _grouped(nodes, nodes.count() // size + 1, F.floor(F.col("pos") / size)).groupBy("block").applyInArrow(_per_group(_paths, levels, fanout), _PATH)
        if above is not None:  # a node of the tier above has at most one bucket of nodes below it
            own = own.withColumn("up", F.floor(F.col("pos") / size)).join(above.select("tree", F.col("pos").alias("up"), F.col("lft").alias("l2"), F.col("rgt").alias("r2")), ["tree", "up"]).select("tree", "pos", F.concat("lft", "l2").alias("lft"), F.concat("rgt", "r2").alias("rgt"))
        above = saved(own)
    return above


def manifest(docs: DataFrame, *, levels: int = BLOCK_LEVELS, fanout: int = FANOUT) -> DataFrame:
    """The manifest of ``docs`` (doc_id, source, lang, n_chars, text): one row a document with its proof, checked.

    Nulls in any column are hashed as such; null ids and the null source come
    first; a null id is never tampered with. Rows of one id and source are ordered by their leaves (repeated
    rows are interchangeable). Empty and very long texts are hashed whole. A single
    document is its own root, with an empty proof. An empty table gives no row.
    Other columns are left out, whatever their names. Very many sources are a tree like any other.
    """
    size = fanout**levels
    # a source's tree is named so that null comes first and order is by bytes
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("tree")
    hashed = docs.select("doc_id", tree, leaf_of(F.col("text")).alias("digest"), leaf_of(tampered(F.col("text"))).alias("other"), F.monotonically_increasing_id().alias("tie"))
    leaves = saved(numbered(hashed, "tree", "doc_id", "digest", "tie"))  # the last deals equal rows, which are interchangeable, to several ranges
    tiers, subroots = climb(leaves, levels, fanout)
    sources = saved(numbered(subroots.select("tree", "digest").withColumn("all", F.lit("")), "all", "tree"))
    top_leaves = sources.select(F.col("all").alias("tree"), "pos", "digest")
    top_tiers, roots = climb(top_leaves, levels, fanout)
    to_root = paths([top_leaves, *top_tiers], levels, fanout).select(F.col("pos").alias("source_pos"), F.col("lft").alias("l2"), F.col("rgt").alias("r2"))
    root = (roots.first() or (None, None))[1]
    buckets = saved(paths(tiers, levels, fanout))
    many = tiers[0].groupBy("tree").agg(F.count(F.lit(1)).alias("m"))
    ends = saved(sources.select("tree", F.col("pos").alias("source_pos"), F.col("digest").alias("subroot")).join(to_root, "source_pos").join(many, "tree").select("tree", "subroot", "l2", "r2", "m"))
    outer = join_per_key(buckets, ends, "tree", buckets.count()).select("tree", "pos", F.concat("lft", "l2").alias("lft"), F.concat("rgt", "r2").alias("rgt"), "subroot", F.lit(root).cast("string").alias("root"))

    def folded(inner: pa.Table, outside: pa.Table) -> pa.Table:
        return _fold(inner, outside, levels, fanout)

    groups = leaves.count() // size + 1
    inner = _grouped(leaves.select("tree", "pos", "doc_id", "digest", "other"), groups, F.floor(F.col("pos") / size)).groupBy("block")
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return inner.cogroup(_grouped(outer, groups, F.col("pos")).groupBy("block")).applyInArrow(folded, schema)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


#: The unsigned CRC-32 of a decimal id, bit by bit.
_CRC32 = """xor(4294967295, list_reduce([4294967295] || list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ord(c) as bigint)),
  lambda crc, byte: list_reduce([xor(crc, byte)] || range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _sql_field(column: str) -> str:
    return f"coalesce(strlen(cast({column} as varchar)) || ':' || cast({column} as varchar), '-')"


ORACLE = rf"""
with recursive leaves as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos from (
    select doc_id, source, coalesce('s' || source, '') as tree, sha256({" || ".join(_sql_field(c) for c in _FIELDS)}) as leaf,
      sha256({" || ".join(_sql_field(c if c != "text" else "edited") for c in _FIELDS)}) as other
    from (select *, case when {_CRC32} % 2 = 0 then replace(text, chr(10), '') else text end as edited from documents))),
nodes as (
  select tree, 0 as level, pos as idx, leaf as digest from leaves
  union all
  select tree, level + 1, idx // 3, sha256(string_agg(digest, '' order by idx)) from (select *, count(*) over (partition by tree) as n from nodes)
  where n > 1 group by tree, level, idx // 3),
tops as (select tree, max(level) as height, max_by(digest, level) as subroot from nodes group by tree),
named as (select *, row_number() over (order by encode(tree)) - 1 as spos from tops),
upper as (
  select 0 as level, spos as idx, subroot as digest from named
  union all
  select level + 1, idx // 3, sha256(string_agg(digest, '' order by idx)) from (select *, count(*) over () as n from upper) where n > 1 group by level, idx // 3),
whole as (select max_by(digest, level) as root, max(level) as height from upper),
places as (select row_number() over () as r, l.*, n.spos, n.height as own, n.subroot, w.root, w.height as above from leaves l join named n using (tree), whole w),
siblings as (
  select r, level, idx, digest, idx < spot as ahead from (select p.r, x.level, x.idx, x.digest, p.pos // cast(pow(3, x.level) as bigint) as spot, own from places p join nodes x using (tree)) where level < own and idx // 3 = spot // 3 and idx <> spot
  union all
  select r, own + level, idx, digest, idx < spot from (select p.r, p.own, x.level, x.idx, x.digest, p.spos // cast(pow(3, x.level) as bigint) as spot, above from places p, upper x) where level < above and idx // 3 = spot // 3 and idx <> spot),
steps as (select r, level, coalesce(string_agg(digest, '' order by idx) filter (ahead), '') as lft, coalesce(string_agg(digest, '' order by idx) filter (not ahead), '') as rgt from siblings group by r, level),
folded as (
  select r, 0 as level, other as digest, own + above as height from places
  union all
  select f.r, f.level + 1, sha256(coalesce(s.lft, '') || f.digest || coalesce(s.rgt, '')), height from folded f left join steps s on f.r = s.r and f.level = s.level where f.level < height)
select doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) as proof_sha256, f.digest as folded_root, f.digest = root as verified
from places join (select r, digest from folded where level = height) f using (r) left join (select r, string_agg(digest, '' order by level, idx) as proof from siblings group by r) using (r)
"""
