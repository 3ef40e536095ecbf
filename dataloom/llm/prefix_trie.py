"""Conversation prefix trie: the distinct beginnings of conversations, with what each subtree holds.

A node is a distinct sequence of first turns (role and text); its key is a hash of 128 bits chained over the turns, so
that equal beginnings have equal keys wherever they are met. Every partition reads its conversations as a sorted
stream and builds a partial trie: a table of nodes with members counted and ends listed, written out whenever it
has `TABLE_NODES` nodes. Partial tables are merged by key in rounds, `FAN_IN` tables into one at a time, each round
combined map-side; members add up, the smallest member stays. End lists are merged in two steps: the ids of one node and one range of
`END_RUN` ids are sorted into one text each, and the texts of a node are hashed as a stream in order, so that no list is ever
whole in memory.

The bottom-up rollup needs only nodes with several members (a node with one member has one leaf below it and
saves nothing). Their sums double in reach: in each round a node gives what it has to the ancestor at distance 1, 2,
4, ..., until no node is that deep. Ancestors and parents are looked up in salted joins, as one beginning
may have any number of continuations.

Turns of one number in one conversation go by their digest; a null number comes first; null role and text are
empty; repeated rows are turns of their own. Rows without a conversation id belong to none and are left out. An empty
table has no nodes, not even a root. Turns are told by digest and length from the first shuffle on, so texts of any
length do not travel; a conversation's turns are a stream in one task, of which only the last key is held. Only
the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dataloom.llm.common import checkpointed, salted_join, text_or_empty

#: Nodes in a partial table, at most; and tables merged into one in a round.
TABLE_NODES, FAN_IN = 50_000, 64
#: Bits of the ids of one node that go to one text of ends.
END_RUN = 12

ROOT = bytes(16)
_NODE = ["key", "parent", "depth", "last_bytes"]


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv, i, digest, bytes): the turns of every conversation, numbered from 1, told by digest of role and text."""
    role, text = text_or_empty(role_col), text_or_empty(text_col)
    told = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.unhex(F.substring(told, 1, 32)).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    order = W.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "digest", "bytes")
    return rows.withColumn("i", F.row_number().over(order)).drop("turn")


def with_borrowed_beginnings(rows: DataFrame, lender: Column, length: Column, longest: int) -> DataFrame:
    """The turns of every conversation behind its first `length`, after the first `length` of the conversation `lender`.

    lender, length: of column conv; length is at most `longest`. A row with i = 0 and no digest opens every conversation, so that one
    without turns is there too.
    """
    convs = rows.where("i = 1").select("conv", lender.alias("lender"), length.cast("int").alias("length"))
    own = rows.where(F.col("i") > length)
    lent = rows.where(F.col("i") <= longest).withColumnRenamed("conv", "lender").join(convs, "lender").where("i <= length")
    opening = convs.select("conv", F.lit(0).alias("i"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    return opening.unionByName(own.select(*opening.columns)).unionByName(lent.select(*opening.columns))


def _partial_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tables of nodes from turns (conv, i, digest, bytes) sorted by conv and i; a row with i = 0 opens a conversation."""
    task = TaskContext.get()
    number, nodes = (task.partitionId() if task else 0) << 20, {}
    key, depth, conv = None, 0, None

    def table() -> pa.RecordBatch:
        rows = [(k, *v[:5], v[5], number) for k, v in nodes.items()]
        columns = list(zip(*rows))
        types = [pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [*_NODE, "least", "n_convs", "ends", "table_no"])

    def member(k: bytes, parent: bytes | None, depth: int, size: int) -> list:
        node = nodes.get(k)
        if node is None:
            node = nodes[k] = [parent, depth, size, conv, 0, []]
        node[3] = min(node[3], conv)
        node[4] += 1
        return node

    at, size = None, 0  # parent and bytes of the node the conversation is at
    for batch in batches:
        for c, i, digest, n in zip(*(batch.column(x).to_pylist() for x in range(4))):
            if i == 0:
                if conv is not None:
                    nodes[key][5].append(conv)
                    if len(nodes) >= TABLE_NODES:
                        yield table()
                        nodes.clear()
                        number += 1
                conv, key, depth = c, ROOT, 0
                member(ROOT, None, 0, 0)
            else:
                at, size, depth = key, n, depth + 1
                key = hashlib.blake2b(at + digest, digest_size=16).digest()
                if len(nodes) >= 2 * TABLE_NODES:  # within a long conversation
                    yield table()
                    nodes.clear()
                    number += 1
                member(key, at, depth, size)
    if conv is not None:
        nodes[key][5].append(conv)
    if nodes:
        yield table()


def partial_tries(rows: DataFrame) -> DataFrame:
    """Rows (key, parent, depth, last_bytes, least, n_convs, ends, table_no) of turns (conv, i, digest, bytes)."""
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "i").select("conv", "i", "digest", "bytes")
    return dealt.mapInArrow(_partial_tries, "key binary, parent binary, depth int, last_bytes long, least long, n_convs long, ends array<long>, table_no long")


def merged(tables: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One table of nodes (key, parent, depth, last_bytes, least, n_convs) of all partial ones."""
    numbers = tables.select("table_no").distinct()
    order = numbers.select("table_no", (F.row_number().over(W.orderBy("table_no")) - 1).alias("t"))  # a number per table, not per row
    tables = tables.join(F.broadcast(checkpointed(order)), "table_no").select(*_NODE, "least", "n_convs", "t")
    left = order.count()
    while True:
        left = -(-left // fan_in)
        by = [*_NODE, F.floor(F.col("t") / fan_in).alias("t")]
        tables = tables.groupBy(*by).agg(F.min("least").alias("least"), F.sum("n_convs").alias("n_convs"))
        if left <= 1:
            return tables.drop("t")


def _hashed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined texts of each key, from rows (key, text) sorted by key and place."""
    key, state = None, None
    for batch in batches:
        done = []
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k == key:
                state.update(b",")
            else:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            state.update(text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["key", "ends_sha256"])


def end_hashes(tables: DataFrame) -> DataFrame:
    """Rows (key, ends_sha256): SHA-256 of the ascending, comma-joined ids of the conversations that end at each node."""
    ends = tables.where(F.size("ends") > 0).select("key", F.explode("ends").alias("conv"))
    runs = ends.groupBy("key", F.shiftright("conv", END_RUN).alias("run")).agg(F.array_sort(F.collect_list("conv")).alias("ids"))
    texts = runs.select("key", "run", F.array_join(F.col("ids").cast("array<string>"), ",").alias("text"))
    return texts.repartition("key").sortWithinPartitions("key", "run").select("key", "text").mapInArrow(_hashed_texts, "key binary, ends_sha256 string")


def rolled_up(shared: DataFrame) -> DataFrame:
    """Rows (key, leaves, saved): sums over the subtree of each row of `shared` (key, parent, leaves, saved)."""
    sums = checkpointed(shared.select("key", "leaves", "saved"))
    up = checkpointed(shared.where(F.col("parent").isNotNull()).select("key", F.col("parent").alias("above")))
    while not up.isEmpty():
        given = up.join(sums, "key").groupBy(F.col("above").alias("key")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        sums = checkpointed(sums.join(given, "key", "left").select(
            "key", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]
        ))
        twice = up.select(F.col("key").alias("above"), F.col("above").alias("higher"))
        up = checkpointed(salted_join(up, twice, "above", F.col("key")).select("key", F.col("higher").alias("above")))
    return sums


def prefix_trie(rows: DataFrame) -> DataFrame:
    """Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_bytes, ends_sha256.

    rows: (conv, i, digest, bytes) with an opening row (i = 0) per conversation; see `with_borrowed_beginnings` and the module.
    """
    tables = checkpointed(partial_tries(rows))
    nodes = checkpointed(merged(tables))
    below = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(
        F.count("*").alias("n_children"), F.sum((F.col("n_convs") == 1).cast("long")).alias("single"),
    )
    known = checkpointed(nodes.join(below, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))
    childless = F.col("n_children") == 0
    shared = known.where("n_convs > 1").select(
        "key", "parent", F.when(childless, F.lit(1)).otherwise(F.col("single")).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("last_bytes")).alias("saved"),
    )
    whole = known.join(rolled_up(shared), "key", "left").join(end_hashes(tables), "key", "left")
    whole = whole.select(
        "key", "parent", F.col("least").alias("conv_id"), "depth", "n_convs", "n_children", F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_bytes"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
    whole = checkpointed(whole)
    parents = whole.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = ["conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_bytes", "ends_sha256"]
    root = whole.where(F.col("parent").isNull()).withColumn("parent_conv_id", F.lit(None).cast("long"))
    return salted_join(whole.where(F.col("parent").isNotNull()), parents, "parent", F.col("key")).select(*out).unionByName(root.select(*out))


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, r, x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(length(r) AS VARCHAR) || ':' || r || x)) AS i
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
  SELECT conv_id, xor(4294967295, list_reduce(
    list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda y, z: xor(y >> 1, CAST(3988292384 AS BIGINT) * (y & 1))))) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT conv_id, i, r, x FROM turns JOIN convs USING (conv_id) WHERE i > h
  UNION ALL
  SELECT c.conv_id, t.i, t.r, t.x FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 5 WHERE t.i <= c.h),
paths AS (
  SELECT conv_id, 0 AS d, '' AS path, 0 AS bytes FROM convs
  UNION ALL
  SELECT conv_id, row_number() OVER w AS d,
    sha256(string_agg(CAST(length(r) AS VARCHAR) || ':' || r || CAST(length(x) AS VARCHAR) || ':' || x, '') OVER w) AS path, octet_length(encode(x)) AS bytes
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
members AS (
  SELECT conv_id, d, bytes, min(conv_id) OVER (PARTITION BY d, path) AS node, max(d) OVER (PARTITION BY conv_id) AS turns FROM paths),
nodes AS (
  SELECT node, d, count(*) AS n_convs, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (turns = d), '')) AS ends_sha256
  FROM members GROUP BY node, d),
parents AS (SELECT n.node, n.d, m.node AS parent FROM nodes n LEFT JOIN members m ON m.conv_id = n.node AND m.d = n.d - 1),
children AS (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM parents WHERE parent IS NOT NULL GROUP BY ALL),
subtrees AS (
  SELECT m.node, m.d, count(*) FILTER (c.node IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved
  FROM nodes n JOIN members m ON m.conv_id = n.node AND m.d <= n.d LEFT JOIN children c ON c.node = n.node AND c.d = n.d
  GROUP BY m.node, m.d)
SELECT n.node AS conv_id, CAST(n.d AS BIGINT) AS depth, p.parent AS parent_conv_id, n.n_convs, CAST(coalesce(c.n_children, 0) AS BIGINT) AS n_children,
  s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN parents p USING (node, d) JOIN subtrees s USING (node, d) LEFT JOIN children c USING (node, d)
"""
