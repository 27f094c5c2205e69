"""Prefix trie of conversations by smallest-member ownership, without building a tree anywhere.

A node is a distinct sequence of first turns (role, text); its members are the conversations that start with it, and its
owner is the smallest member. Along a conversation's path owners never decrease, so each conversation owns a suffix of
its path (perhaps none, if a smaller one has all its turns) and (owner, depth) names a node. What a subtree holds then
adds up over members alone:

* every node of the subtree counts its text once for each member that reaches it, and once for the owner; a member adds
  the characters of its path from the node's depth on, less those that it owns there, which is what sharing saves;
* a leaf ends its owner's path, so leaves are members that own a childless node;
* a child is owned by the node's owner, or starts the owned suffix of one other conversation.

Steps: turns are numbered by a window in each conversation and shrink to a digest and a length; another window runs over
digests and lengths, which gives every prefix a key of 192 bits (exclusive or of hashes of depth and SHA-256 of the
turn); one grouping finds owners, windows' sums tell what each conversation owns, and one grouping by prefix adds up. A
hot prefix is combined before it is shuffled. The ids that end at a node are dealt in ranges, joined into blocks of text,
and hashed block by block, so that a node at which a third of all conversations end takes one task no list of them.

Turns are ordered by turn (null first), then role, then digest; a null role or text is empty. Rows without a conversation
id belong to none. Repeated rows are turns of their own. An empty table gives no node. Other columns are ignored. The
turns of one conversation are sorted in one task, which spills.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, map_arrow

KEY = ["x0", "x1", "x2"]
#: Characters of ids joined into one block.
BLOCK = 1 << 20


def _hash(i: int, depth: Column, mark: Column) -> Column:
    return F.xxhash64(F.lit(i), depth.cast("long"), mark)


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, k, mark, n): the turns of every conversation from 1, each a digest of role and text and the text's length."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    mark = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), mark.alias("mark"), F.char_length(text).cast("long").alias("n"))
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "mark"))
    return cut_lineage(turns.select("conv_id", k.alias("k"), "mark", "n"))


def paths(turns: DataFrame, *, every: int = 100, heads: int = 6) -> DataFrame:
    """(conv_id, depth, x0, x1, x2, n, upto, length, total): every prefix of every rebuilt conversation, the root's included.

    Conversation c is the first h turns of conversation c - c % ``every``, then its own after its first h, where h is
    the unsigned CRC-32 of the decimal c modulo ``heads``; with ``heads`` = 1 conversations stay as they are. n is the
    length of the last text, upto of all so far; length and total are of the whole conversation.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    own = turns.withColumn("h", h).groupBy("conv_id", "h").agg(F.max("k").alias("own"), F.coalesce(F.sum(F.when(F.col("k") > F.col("h"), F.col("n"))), F.lit(0)).alias("own_chars"))
    base = turns.filter((F.col("conv_id") % every == 0) & (F.col("k") < heads)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("k", "mark", "n"))).alias("head"))  # fewer than ``heads`` rows each
    none = F.expr("cast(array() as array<struct<k:int,mark:binary,n:bigint>>)")
    convs = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(base, "base", "left").withColumn("head", F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), none))
    m = F.size("head")
    length = m + F.greatest(F.lit(0), F.col("own") - F.col("h"))

    def along(upto: Column) -> list[Column]:
        part = F.slice("head", F.lit(1), upto)
        fold = lambda i: lambda a, t: a.bitwiseXOR(_hash(i, t["k"], t["mark"]))
        keys = [F.aggregate(part, F.lit(0).cast("long"), fold(i)).alias(x) for i, x in enumerate(KEY)]
        return [*keys, F.aggregate(part, F.lit(0).cast("long"), lambda a, t: a + t["n"]).alias("upto")]

    convs = convs.select("conv_id", "h", "head", m.alias("m"), length.cast("long").alias("length"), (along(m)[-1] + F.col("own_chars")).alias("total"))
    inherited = convs.select("conv_id", "length", "total", "head", F.explode(F.sequence(F.lit(0), "m")).alias("depth"))
    n = F.when(F.col("depth") > 0, F.element_at("head", F.greatest(F.lit(1), F.col("depth")))["n"]).otherwise(0)
    inherited = inherited.select("conv_id", F.col("depth").cast("long").alias("depth"), *along(F.col("depth")), n.alias("n"), "length", "total")
    rest = turns.join(convs.select("conv_id", "h", "m", "length", "total", *along(F.col("m"))), "conv_id").filter("k > h").withColumn("depth", (F.col("m") + F.col("k") - F.col("h")).cast("long"))
    so_far = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    keys = [F.col(x).bitwiseXOR(F.bit_xor(_hash(i, F.col("depth"), F.col("mark"))).over(so_far)).alias(x) for i, x in enumerate(KEY)]
    rest = rest.select("conv_id", "depth", *keys, (F.col("upto") + F.sum("n").over(so_far)).alias("upto"), "n", "length", "total")
    return inherited.unionByName(rest)


def trie(rows: DataFrame) -> DataFrame:
    """A row for each node of the paths ``rows`` (see ``paths``); columns as in the module's queries."""
    rows = cut_lineage(rows)
    # who owns which node, and what each conversation owns: from depth ``since`` on, ``before`` characters stand ahead of it
    owners = rows.groupBy("depth", *KEY).agg(F.min("conv_id").alias("owner"), F.max("length").alias("longest"), F.min(F.col("upto") - F.col("n")).alias("ahead"))
    owned = owners.groupBy(F.col("owner").alias("conv_id")).agg(F.min("depth").alias("since"), F.min("ahead").alias("before"), F.max((F.col("longest") == F.col("depth")).cast("long")).alias("leaf"))
    marked = rows.join(owned, "conv_id", "left").select(
        *KEY, "depth", "conv_id", "length",
        (F.coalesce(F.col("before"), F.col("total")) - (F.col("upto") - F.col("n"))).alias("saved"),
        F.coalesce("since", F.col("length") + 1).alias("since"),
        F.coalesce("leaf", F.lit(0)).alias("leaf"),
        F.col("since").isNotNull().alias("owns"),
    )
    marked = cut_lineage(marked)
    starts = (F.col("depth") == F.col("since") - 1) & F.col("owns")
    nodes = marked.groupBy("depth", *KEY).agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.count_if(starts).alias("started"),
        F.min_by("length", "conv_id").alias("length"),
        F.min_by("since", "conv_id").alias("since"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.when(F.col("depth") < F.col("since"), F.col("saved")).otherwise(0)).alias("saved_tokens"),
    )
    nodes = cut_lineage(nodes)
    # the parent of a conversation's first own node is owned by another
    above = marked.filter(starts).select(F.col("conv_id").alias("child"), "depth", *KEY)
    above = above.join(nodes.select("depth", *KEY, "conv_id"), ["depth", *KEY]).select(F.col("child").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("above"))
    ends = end_digests(marked.filter("depth = length").select(*KEY, "depth", "conv_id"))
    made = nodes.join(above, ["conv_id", "depth"], "left").join(ends, ["depth", *KEY], "left")
    return made.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") > F.col("since"), F.col("conv_id")).otherwise(F.col("above")).cast("long").alias("parent_conv_id"),
        "n_convs",
        (F.col("started") + (F.col("length") > F.col("depth")).cast("long")).alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def end_digests(ends: DataFrame) -> DataFrame:
    """(x0, x1, x2, depth, ends_sha256): SHA-256 of the conversation ids of each node of ``ends``, ascending, comma-joined.

    Ranges of (node, id) are joined into blocks of text where they stand; a node's blocks are then hashed in order.
    """
    node = [*KEY, "depth"]
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = pa.schema([*((c, pa.int64()) for c in node), ("first", pa.int64()), ("ids", pa.string())])
    digest = pa.schema([*((c, pa.int64()) for c in node), ("ends_sha256", pa.string())])

    def runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
        x = np.stack([np.asarray(batch.column(i)) for i in range(len(node))])
        starts = np.flatnonzero(np.r_[True, (x[:, 1:] != x[:, :-1]).any(axis=0)])
        for s, e in zip(starts, np.r_[starts[1:], x.shape[1]], strict=True):
            yield tuple(int(v) for v in x[:, s]), int(s), int(e)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, size = None, [], 0

        def flush() -> tuple:
            return (*of, int(held[0]), ",".join(held))

        for batch in batches:
            if not batch.num_rows:
                continue
            made, ids = [], [str(v) for v in batch.column(len(node)).to_pylist()]
            for key, s, e in runs(batch):
                if held and (key != of or size > BLOCK):
                    made.append(flush())
                    held, size = [], 0
                of = key
                held += ids[s:e]
                size += sum(map(len, ids[s:e]))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*made, strict=True), block, strict=True)], schema=block)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(flush(), strict=True), block, strict=True)], schema=block)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, sha = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            made, ids = [], batch.column(len(node) + 1).to_pylist()
            for key, s, e in runs(batch):
                for text in ids[s:e]:
                    if key == of:
                        sha.update(b"," + text.encode())
                    else:
                        if of is not None:
                            made.append((*of, sha.hexdigest()))
                        of, sha = key, hashlib.sha256(text.encode())
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*made, strict=True), digest, strict=True)], schema=digest)
        if of is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip((*of, sha.hexdigest()), digest, strict=True)], schema=digest)

    keys = "x0 long, x1 long, x2 long, depth long"
    dealt = ends.select(*node, "conv_id").repartitionByRange(parts, *node, "conv_id").sortWithinPartitions(*node, "conv_id")
    blocks = map_arrow(dealt, join, f"{keys}, first long, ids string")
    return map_arrow(blocks.repartition(parts, *node).sortWithinPartitions(*node, "first"), hashed, f"{keys}, ends_sha256 string")


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    return trie(paths(numbered(conversations)))


#: Unsigned CRC-32 (reflected polynomial 0xEDB88320) of the decimal digits of a number, a bit at a time.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda s: ascii(s)::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda r, i: case when r & 1 = 1 then xor(3988292384, r >> 1) else r >> 1 end)))"""
SQL = f"""
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as k
  from conversations where conv_id is not null),
convs as (select conv_id, {_CRC} % 6 as h from (select distinct conv_id from turns)),
heads as (
  select c.conv_id, t.k as depth, t.role, t.text from convs c join turns t on t.conv_id = c.conv_id - c.conv_id % 100 and t.k <= c.h),
sizes as (select c.conv_id, c.h, count(s.depth) as m from convs c left join heads s on s.conv_id = c.conv_id group by all),
whole as (
  select * from heads
  union all select t.conv_id, s.m + t.k - s.h, t.role, t.text from turns t join sizes s on s.conv_id = t.conv_id and t.k > s.h),
paths as (
  select conv_id, 0 as depth, 'root' as node, 0 as n from convs
  union all select conv_id, depth, depth || ':' || sha256(string_agg(length(role) || ':' || role || sha256(text), '|') over (partition by conv_id order by depth)), length(text) from whole),
nodes as (select node, min(conv_id) as conv_id, any_value(depth) as depth, count(*) as n_convs, any_value(n) as n from paths group by node),
links as (
  select distinct p.node, a.node as above from paths p join paths a on a.conv_id = p.conv_id and a.depth = p.depth - 1),
up as (
  select links.node, a.conv_id as parent_conv_id, above from links join nodes a on a.node = above),
children as (select above as node, count(*) as n from links group by 1),
lengths as (select conv_id, max(depth) as depth from paths group by 1),
ends as (
  select node, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends_sha256 from paths join lengths using (conv_id, depth) group by node),
below as (
  select p.node, sum((y.n_convs - 1) * y.n)::bigint as saved_tokens, count(*) filter (y.node not in (select node from children))::bigint as n_leaves
  from nodes y join paths p on p.conv_id = y.conv_id and p.depth <= y.depth group by p.node)
select n.conv_id, n.depth::bigint as depth, up.parent_conv_id, n.n_convs::bigint as n_convs, coalesce(children.n, 0)::bigint as n_children,
  b.n_leaves, b.saved_tokens, coalesce(ends.ends_sha256, sha256('')) as ends_sha256
from nodes n join below b using (node) left join up using (node) left join children using (node) left join ends using (node)"""
