"""Merkle manifest of a dataset: a digest of every row, a root over all, and for each row the siblings that lead from one to the other.

Trees have runs of three. Each source is a tree over its rows, and a tree over the
sources' roots gives the root of all. Trees are worked on in aligned blocks of
``3 ** LEVELS`` nodes. Upwards, each block gives its own root, and these are the nodes
of the next pass. Downwards, each block's authentication paths are made by a
traversal that goes from node to node and keeps, for each level, the run that the path
goes through and a treehash stack that gets the next run ready; what lies above the
block is one path, which all of its nodes share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chirplake.llm.util import join_checked, running, saved
from chirplake.ship import ship

#: Children of a node.
ARITY = 3
#: Levels of a block: 2187 nodes, some hundred kilobytes.
LEVELS = 7
BLOCK = ARITY**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def _digest(nodes: Sequence[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _height(width: int) -> int:
    """Levels above ``width`` nodes."""
    levels, reach = 0, 1
    while reach < width:
        levels, reach = levels + 1, reach * ARITY
    return levels


class Treehash:
    """Makes the nodes of one level out of a stretch of leaves, one leaf an update, holding at most two pending nodes a level."""

    def __init__(self, leaves: Sequence[str], level: int, start: int, stop: int) -> None:
        self.leaves, self.level, self.at, self.stop = leaves, level, start, min(stop, len(leaves))
        self.pending: list[list[str]] = [[] for _ in range(level)]
        self.made: list[str] = []

    def update(self) -> None:
        if self.at >= self.stop:
            return
        self._push(0, self.leaves[self.at])
        self.at += 1
        if self.at == len(self.leaves):  # the last runs may be short
            for level, nodes in enumerate(self.pending):
                if nodes:
                    self.pending[level] = []
                    self._push(level + 1, _digest(nodes))

    def _push(self, level: int, node: str) -> None:
        while level < self.level:
            run = self.pending[level]
            run.append(node)
            if len(run) < ARITY:
                return
            self.pending[level] = []
            level, node = level + 1, _digest(run)
        self.made.append(node)

    def finished(self) -> list[str]:
        while self.at < self.stop:
            self.update()
        return self.made


def block_root(leaves: Sequence[str], levels: int) -> str:
    return Treehash(leaves, levels, 0, len(leaves)).finished()[0]


def traversed(leaves: Sequence[str], levels: int) -> Iterator[tuple[list[str], list[str]]]:
    """For each leaf, the siblings before and after its path on each level (concatenated), by Merkle traversal.

    ``runs`` has, for each level, the nodes of the run that the path goes through;
    that on the path itself may be unknown. While a run is gone through, its level's
    treehash reads what is under the second and third node of the next run: two
    thirds of an update a leaf. The first node of a run is folded from the path
    when its last leaf is left.
    """
    ahead = [Treehash(leaves, h, ARITY**h, ARITY ** (h + 1)) for h in range(levels)]
    runs: list[list[str | None]] = [[None, *stack.finished()] for stack in ahead]

    def prepared(h: int, run: int) -> Treehash:
        size = ARITY ** (h + 1)
        return Treehash(leaves, h, run * size + ARITY**h, (run + 1) * size)

    ahead = [prepared(h, 1) for h in range(levels)]
    for i, leaf in enumerate(leaves):
        lefts, rights, place = [], [], i
        for run in runs:
            place, own = divmod(place, ARITY)
            lefts.append("".join(run[:own]))
            rights.append("".join(run[own + 1 :]))
        yield lefts, rights
        for stack in ahead:
            stack.update()
        node, step = leaf, i + 1
        for h in range(levels):
            step, own = divmod(step, ARITY)  # the place in its run that the path moves to
            if own:
                runs[h][own - 1] = node
                break
            node = _digest([*runs[h][:-1], node])  # only a run of three is left like this before the end
            runs[h], ahead[h] = [None, *ahead[h].finished()], prepared(h, step + 1)


# ------------------------------------------------------------------ rows
def _encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 of the values, each as its length in UTF-8 bytes, a colon and itself, or as a hyphen if null."""
    return F.sha2(F.concat(*[_encoded(c) for c in columns]), 256)


def _forest(nodes: DataFrame, label: str) -> list[DataFrame]:
    """The nodes (tree, width, place, node) and, pass by pass, the roots of their blocks, until each tree has one; at least one pass."""
    ship(nodes.sparkSession)
    widest = nodes.agg(F.max("width").alias("w")).first()["w"] or 1
    schema = "tree bigint, width bigint, place bigint, node string"

    def rise(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        width = rows.column("width")[0].as_py()
        root = block_root(rows.column("node").to_pylist(), min(LEVELS, _height(width)))
        return pa.table({"tree": [key[0].as_py()], "width": [-(-width // BLOCK)], "place": [key[1].as_py()], "node": [root]}, pa.schema([("tree", pa.int64()), ("width", pa.int64()), ("place", pa.int64()), ("node", pa.string())]))

    out = [nodes]
    while widest > 1 or len(out) == 1:
        blocks = out[-1].select("tree", "width", "place", "node", F.floor(F.col("place") / BLOCK).alias("block"))
        out.append(saved(blocks.groupBy("tree", "block").applyInArrow(rise, schema), label))
        widest = -(-widest // BLOCK)
    return out


_PATH = "lefts array<string>, rights array<string>"


def _descend(nodes: DataFrame, upper: DataFrame) -> DataFrame:
    """Add the path (lefts, rights) up to the root of all to each node: through its block, then the path of the block's root in ``upper`` (tree, place, lefts, rights)."""
    kept = [f for f in nodes.schema.fields if f.name not in ("tree", "place")]
    names = ["tree", "place", *[f.name for f in kept], "lefts", "rights"]
    schema = ", ".join(["tree bigint, place bigint", *[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], _PATH])

    def path(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        levels = min(LEVELS, _height(rows.column("width")[0].as_py()))
        over, under = above.column("lefts")[0].as_py(), above.column("rights")[0].as_py()
        lefts, rights = [], []
        for left, right in traversed(rows.column("node").to_pylist(), levels):
            lefts.append(left + over)
            rights.append(right + under)
        kind = pa.list_(pa.string())
        return pa.Table.from_arrays([rows.column("tree"), rows.column("place"), *[rows.column(f.name) for f in kept], pa.array(lefts, kind), pa.array(rights, kind)], names)

    below = nodes.withColumn("block", F.floor(F.col("place") / BLOCK)).groupBy("tree", "block")
    return below.cogroup(upper.withColumnRenamed("place", "block").groupBy("tree", "block")).applyInArrow(path, schema)


def proofs(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, changed, subroot, root, lefts, rights of every document.

    ``docs`` needs doc_id, source, lang, n_chars and text; ``leaf`` is their digest (see
    :func:`leaf_digest`). ``lefts`` and ``rights`` are the siblings before and after the path
    on each level, from the leaf to the root, each level's concatenated ("" where there
    are none). ``changed`` is the digest of the row as :func:`tampered` leaves it, null
    where that changes nothing.

    Per source, leaves ascend by doc_id (null first; rows that repeat a doc_id by their
    leaves, and equal rows are alike). Sources ascend by their bytes, null first. A lone
    leaf is its source's root, and a lone source's root is the root. Rows are numbered in
    ranges of (source, doc_id, leaf), so a source with a third of all rows is many
    ranges and many blocks. Nulls are digested as such, an empty text as one of length
    zero, a very long text like any other. An empty table gives an empty table. Other
    columns, whatever their names, play no part.
    """
    ship(docs.sparkSession)
    columns = [F.col(c) for c in COLUMNS]
    text = F.col("text")
    other = leaf_digest([*columns[:-1], F.translate(text, "\n", "")])
    rows = docs.select("doc_id", "source", leaf_digest(columns).alias("leaf"), F.when(tampered(F.col("doc_id")) & text.contains("\n"), other).alias("changed"))
    rows = saved(rows, "digests")  # dealing out ranges reads its rows twice
    placed = running(rows, [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")], "leaves")
    sources = saved(placed.groupBy("source").agg(F.min("place").alias("tree"), F.count("*").alias("width")), "sources")
    name = lambda c: F.coalesce(F.concat(F.lit("s"), F.col(c)), F.lit(""))
    leaves = join_checked(placed.withColumn("name", name("source")), sources.select(name("source").alias("name"), "tree", "width"), ["name"], "inner").drop("name")
    leaves = leaves.withColumn("place", F.col("place") - F.col("tree")).withColumnRenamed("leaf", "node")
    trees = _forest(leaves, "nodes")
    subroots = sources.select("source", "tree").join(trees[-1].select("tree", F.col("node").alias("subroot")), "tree")
    ranked = saved(running(subroots, [F.col("source").asc_nulls_first()], "subroots"), "ranked")
    count = F.lit(ranked.count()).cast("bigint")
    tops = _forest(ranked.select(F.lit(0).cast("bigint").alias("tree"), count.alias("width"), "place", F.col("subroot").alias("node")), "tops")
    top = tops[-1].first()
    none = F.array().cast("array<string>")
    path = tops[-1].select("tree", "place", none.alias("lefts"), none.alias("rights"))
    for nodes in reversed(tops[:-1]):
        path = _descend(nodes.select("tree", "width", "place", "node"), path).select("tree", "place", "lefts", "rights")
    path = ranked.select(F.col("tree").alias("own"), "place").join(path.drop("tree"), "place").select(F.col("own").alias("tree"), F.lit(0).cast("bigint").alias("place"), "lefts", "rights")
    for nodes in reversed(trees[1:-1]):
        path = saved(_descend(nodes, path).select("tree", "place", "lefts", "rights"), "paths")
    out = _descend(leaves, path)
    out = join_checked(out, subroots.select("tree", "subroot"), ["tree"], "inner")
    return out.select("doc_id", "source", F.col("node").alias("leaf"), "changed", "subroot", F.lit(top["node"] if top else None).cast("string").alias("root"), "lefts", "rights")


def tampered(doc_id: Column) -> Column:
    """Whether the check tampers with the row: where 2 divides the CRC-32 of the decimal doc_id; a null doc_id is left alone."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))


def folded(leaf: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    levels = F.zip_with(lefts, rights, lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    return F.aggregate(levels, leaf, lambda node, level: F.sha2(F.concat(level["left"], node, level["right"]), 256))


def verified(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id and whether the row is as it was when ``known`` (doc_id, lefts, rights, root, of :func:`proofs`) was made; null for rows without a proof.

    A row that repeats a doc_id is as it was if any proof of that doc_id fits it; a null doc_id has no proof.
    """
    leaves = docs.select("doc_id", leaf_digest([F.col(c) for c in COLUMNS]).alias("leaf"))
    both = leaves.join(known.select("doc_id", "lefts", "rights", "root"), "doc_id", "left")
    fits = (folded(F.col("leaf"), F.col("lefts"), F.col("rights")) == F.col("root")).alias("fits")
    return both.select("doc_id", "leaf", fits).groupBy("doc_id", "leaf").agg(F.max("fits").alias("verified")).drop("leaf")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, the digest of the proof, and the root that the row leads to after tampering."""
    p = proofs(docs).withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("lefts"), F.col("rights")))
    siblings = F.array_join(F.zip_with("lefts", "rights", lambda a, b: F.concat(a, b)), "")
    return p.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


# ------------------------------------------------------------------ the same in SQL
def _sql(levels: int = 13) -> str:
    """All levels written out; enough for 3**13 rows a source and as many sources."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    fields = " || ".join(field(c) for c in COLUMNS[:-1])
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda d, k: xor(d >> 1, 3988292384 * (d & 1)))"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {bits}))"
    other = field("replace(text, chr(10), '')")
    parts = [f"""leaves AS (
  SELECT doc_id, source, sha256({fields} || {field('text')}) AS leaf,
         CASE WHEN coalesce({crc} % 2 = 0, false) THEN sha256({fields} || {other}) ELSE sha256({fields} || {field('text')}) END AS changed FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, row_number() OVER () AS id FROM leaves),
a0 AS (SELECT source AS tree, place, leaf AS node, count(*) OVER (PARTITION BY source) AS width FROM placed)"""]

    def tree(t: str) -> None:
        for k in range(levels):
            below = lambda o: f"CASE WHEN place % 3 >= {o + 1} THEN lag(node, (place % 3 - {o})::INT) OVER w ELSE '' END"
            above = lambda o: f"CASE WHEN place % 3 < {o} THEN coalesce(lead(node, ({o} - place % 3)::INT) OVER w, '') ELSE '' END"
            parts.append(f"""{t}s{k} AS (
  SELECT tree, place, {below(0)} || {below(1)} AS lft, {above(1)} || {above(2)} AS rgt FROM {t}{k} WHERE width > 1 WINDOW w AS (PARTITION BY tree, place // 3 ORDER BY place))""")
            parts.append(f"""{t}{k + 1} AS (
  SELECT tree, place // 3 AS place, CASE WHEN any_value(width) = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY place)) END AS node, (any_value(width) + 2) // 3 AS width
  FROM {t}{k} GROUP BY tree, place // 3)""")

    tree("a")
    parts.append(f"""b0 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS place, node, count(*) OVER () AS width FROM a{levels}),
ranks AS (SELECT tree AS source, node AS subroot, row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS rank FROM a{levels})""")
    tree("b")
    joins, pairs = [], []
    for t, on in (("a", "x.tree IS NOT DISTINCT FROM p.source AND x.place = p.place"), ("b", "x.place = r.rank")):
        for k in range(levels):
            joins.append(f"LEFT JOIN {t}s{k} {t}{k}x ON {on.replace('x.', f'{t}{k}x.').replace('p.place', f'p.place // {3**k}').replace('r.rank', f'r.rank // {3**k}')}")
            pairs.append(f"{{'l': {t}{k}x.lft, 'r': {t}{k}x.rgt}}")
    parts.append(f"""paths AS (
  SELECT p.doc_id, p.leaf, p.changed, r.subroot, list_filter([{', '.join(pairs)}], lambda x: x.l IS NOT NULL) AS path
  FROM placed p JOIN ranks r ON p.source IS NOT DISTINCT FROM r.source {' '.join(joins)}),
done AS (
  SELECT doc_id, leaf, subroot, (SELECT node FROM b{levels}) AS root, sha256(list_aggregate(list_transform(path, lambda x: x.l || x.r) || [''], 'string_agg', '')) AS proof_sha256,
         list_reduce(list_prepend({{'l': changed, 'r': ''}}, path), lambda n, x: {{'l': sha256(x.l || n.l || x.r), 'r': ''}}).l AS folded_root FROM paths)
SELECT *, folded_root = root AS verified FROM done""")
    return "WITH " + ",\n".join(parts)


MANIFEST_SQL = _sql()
