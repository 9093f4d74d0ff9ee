"""Merkle manifest of a dataset, with proofs looked up by coordinates.

A row is a leaf; the leaves of a group (a language) make a tree of pairs, and the groups' roots make the tree above them.
Every node lies in a table under its coordinates (group, level, place). The siblings that prove a leaf are computed from
its place and the group's size alone; they are exploded, joined with the node table, ordered and folded.

Trees are built and proofs are looked up by tiers of ``TIER`` levels. A tier's blocks have up to 2**TIER nodes, so no task
gathers more, and a node is asked for by as many rows at most: what all leaves of a block share above it is looked up once
for the block, not once for each leaf. The node near the root that half of all leaves need is thus no hot key. The driver
holds one number, the height of the highest tree.

``H`` is lower-case hex sha256 of its inputs' text, digests as hex; a value goes in as its UTF-8 byte count, ``:`` and the
value, a null as ``-``. The last node of a level without a partner is hashed alone.

Defined cases: null ids come first in their group and are never tampered with; rows that repeat an id are leaves of their
own, ordered by digest (rows equal in every hashed column may swap places); a null language is a group of its own, before
all others; a group or a dataset of one row has the leaf as root and an empty proof; an empty table gives no rows; a very
long text is hashed whole, as one string of a task; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cirrostrat.llm.common import remainder, written
from cirrostrat.llm.ranks import ranked

TIER = 8
TAMPERED = 7


def digest(*parts: Column) -> Column:
    """H of ``parts`` (text), as bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def text(node: Column) -> Column:
    """A digest as it enters a hash."""
    return F.lower(F.hex(node))


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:`` and value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def height(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1)))


def width(n: Column, level: Column | int) -> Column:
    """Nodes of a level."""
    level = F.lit(level) if isinstance(level, int) else level
    one = F.call_function("shiftleft", F.lit(1).cast("long"), level)
    return F.call_function("shiftright", n + one - 1, level)


def _up(x: Column, levels: Column) -> Column:
    return F.call_function("shiftright", x, levels)


def _pairs(run: Column) -> Column:
    """The level above a run of nodes that begins at an even place."""
    other = lambda j: F.coalesce(text(F.get(run, 2 * j + 1)), F.lit(""))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(run) - 1) / 2).cast("int")), lambda j: digest(text(F.get(run, 2 * j)), other(j)))


@dataclass(frozen=True)
class Forest:
    """Trees by group: ``tiers[0]`` has the leaves, each later one the nodes of the next ``TIER`` levels, all with group,
    n (leaves of the group), level, place and node."""

    tiers: tuple[DataFrame, ...]

    @property
    def nodes(self) -> DataFrame:
        found = self.tiers[0]
        for tier in self.tiers[1:]:
            found = found.union(tier)
        return found

    @property
    def roots(self) -> DataFrame:
        """group and root."""
        return self.nodes.where(F.col("level") == height(F.col("n"))).select("group", F.col("node").alias("root"))


def grow(leaves: DataFrame, tier: int = TIER) -> Forest:
    """The trees of ``leaves`` (group, n, place, node), a table that is read again and again."""
    n, column = F.col("n"), ["group", "n", "level", "place", "node"]
    tiers = [leaves.withColumn("level", F.lit(0)).select(column)]
    highest = leaves.agg(F.max(height(n))).first()[0] or 0
    for base in range(0, highest, tier):
        blocks = (
            tiers[-1].where((F.col("level") == base) & (height(n) > base))
            .groupBy("group", "n", _up(F.col("place"), F.lit(tier)).alias("block"))
            .agg(F.sort_array(F.collect_list(F.struct("place", "node"))).alias("run"))
        )
        levels = F.aggregate(
            F.sequence(F.lit(1), F.least(F.lit(tier), height(n) - base)),
            F.array(F.transform("run", lambda r: r["node"])),
            lambda done, _: F.concat(done, F.array(_pairs(F.element_at(done, -1)))),
        )
        nodes = blocks.select("group", "n", "block", F.posexplode(levels).alias("k", "row")).where("k > 0").select("group", "n", "block", "k", F.posexplode("row").alias("at", "node"))
        place = F.call_function("shiftleft", F.col("block"), F.lit(tier) - F.col("k")) + F.col("at")
        tiers.append(written(nodes.select("group", "n", (F.col("k") + base).alias("level"), place.alias("place"), "node"), "nodes"))
    return Forest(tuple(tiers))


def _looked_up(forest: Forest, t: int, tier: int) -> DataFrame:
    """Siblings of the nodes that begin tier t, as far as that tier reaches: group, place, siblings."""
    n, base = F.col("n"), t * tier
    here = forest.tiers[t].where((F.col("level") == base) & (height(n) > base))
    step = lambda k: F.struct((k + base).alias("level"), _up(F.col("place"), k).bitwiseXOR(F.lit(1)).alias("at"))
    steps = F.transform(F.sequence(F.lit(0), F.least(F.lit(tier), height(n) - base) - 1), step)
    asked = here.select("group", "place", F.explode(F.filter(steps, lambda s: s["at"] < width(n, s["level"]))).alias("s"))
    asked = asked.select("group", "place", F.col("s.level").alias("level"), F.col("s.at").alias("at"))
    nodes = here.union(forest.tiers[t + 1].where(F.col("level") < base + tier)).select("group", "level", F.col("place").alias("at"), "node")
    found = asked.join(nodes, ["group", "level", "at"]).groupBy("group", "place").agg(F.sort_array(F.collect_list(F.struct("level", "node"))).alias("found"))
    return found.select("group", "place", F.transform("found", lambda s: s["node"]).alias("siblings"))


def siblings(forest: Forest, tier: int = TIER) -> DataFrame:
    """group, place and siblings (lowest first) of every leaf that has any."""
    none, above = F.array().cast("array<binary>"), None
    for t in reversed(range(len(forest.tiers) - 1)):
        found = _looked_up(forest, t, tier)
        if above is not None:  # a node without siblings of its own in this tier may have some above it
            here = forest.tiers[t].where((F.col("level") == t * tier) & (height(F.col("n")) > t * tier)).select("group", "place")
            found = here.join(found, ["group", "place"], "left").withColumn("block", _up(F.col("place"), F.lit(tier)))
            up = above.select("group", F.col("place").alias("block"), F.col("siblings").alias("up"))
            found = found.join(up, ["group", "block"], "left").select("group", "place", F.concat(F.coalesce("siblings", none), F.coalesce("up", none)).alias("siblings"))
        above = written(found, "siblings") if t else found
    return forest.tiers[0].select("group", "place", none.alias("siblings")).limit(0) if above is None else above


def folded(start: Column, place: Column, n: Column, proof: Column) -> Column:
    """The root that ``proof`` leads to from a leaf."""
    levels = F.when(height(n) > 0, F.sequence(F.lit(0), height(n) - 1)).otherwise(F.array().cast("array<int>"))

    def step(at: Column, level: Column) -> Column:
        mine, sibling = text(at["node"]), text(F.get(proof, at["used"]))
        paired = F.when(_up(place, level).bitwiseAND(F.lit(1)) == 1, digest(sibling, mine)).otherwise(digest(mine, sibling))
        has = _up(place, level).bitwiseXOR(F.lit(1)) < width(n, level)
        return F.struct(F.when(has, paired).otherwise(digest(mine)).alias("node"), F.when(has, at["used"] + 1).otherwise(at["used"]).alias("used"))

    return F.aggregate(levels, F.struct(start.alias("node"), F.lit(0).alias("used")), step)["node"]


@dataclass(frozen=True)
class Manifest:
    """``leaves``: id, group, place, n, node and tampered of every row; ``trees`` by group and ``top`` over their roots;
    ``groups``: group, subroot, place and n in the top tree, root."""

    leaves: DataFrame
    trees: Forest
    top: Forest
    groups: DataFrame


def manifest(docs: DataFrame, leaf: Column, group: str = "lang", order: str = "doc_id", tampered: Column | None = None, tier: int = TIER) -> Manifest:
    """Trees over ``docs``, one for each value of ``group`` and one over those. ``leaf`` is a row's digest; ``tampered``
    may give another one that proofs are to be tried on."""
    key = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group)))  # null first, then bytewise
    rows = docs.select(F.col(order).alias("id"), key.alias("group"), leaf.alias("node"), (leaf if tampered is None else tampered).alias("tampered"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")  # texts are read and hashed once
    placed = ranked(rows, ["group"], [F.col("id").asc_nulls_first(), F.col("node"), F.col("row")])
    leaves = written(placed.select("id", "group", F.col("__rank").alias("place"), F.col("__size").alias("n"), "node", "tampered"), "leaves")
    trees = grow(leaves.select("group", "n", "place", "node"), tier)
    roots = ranked(written(trees.roots, "roots"), [], [F.col("group")])
    groups = written(roots.select("group", F.col("root").alias("subroot"), F.col("__rank").alias("top_place"), F.col("__size").alias("top_n")), "groups")
    top = grow(groups.select(F.lit("").alias("group"), F.col("top_n").alias("n"), F.col("top_place").alias("place"), F.col("subroot").alias("node")), tier)
    root = F.broadcast(top.roots.withColumnRenamed("group", "of"))  # one row
    return Manifest(leaves, trees, top, groups.withColumn("of", F.lit("")).join(root, "of").drop("of"))


def proofs(found: Manifest, tier: int = TIER) -> DataFrame:
    """Every leaf with its siblings in the group's tree and in the top tree, and the roots that they should lead to."""
    none = F.array().cast("array<binary>")
    own = siblings(found.trees, tier)
    above = siblings(found.top, tier).select(F.col("place").alias("top_place"), F.col("siblings").alias("top_siblings"))
    groups = written(found.groups.join(above, "top_place", "left"), "groups")
    rows = found.leaves.join(own, ["group", "place"], "left").join(groups, "group")
    return rows.withColumns({"siblings": F.coalesce("siblings", none), "top_siblings": F.coalesce("top_siblings", none)})


def document_leaf(n_chars: Column) -> Column:
    """The leaf of a row of documents."""
    return digest(field(F.col("doc_id")), field(F.col("source")), field(F.col("lang")), field(n_chars), field(F.col("text")))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs)


def digests(docs: DataFrame, tier: int = TIER) -> DataFrame:
    """Leaves, roots, proofs and what they fold to, where rows whose crc32 of the id 7 divides have been tampered with."""
    docs = docs.select("doc_id", "source", "lang", "n_chars", "text")
    leaf = document_leaf(F.col("n_chars"))
    changed = F.when(remainder("doc_id", TAMPERED) == 0, document_leaf(F.col("n_chars").cast("decimal(38,0)") + 1)).otherwise(leaf)
    rows = proofs(manifest(docs, leaf, tampered=changed, tier=tier), tier)
    own = folded(F.col("tampered"), F.col("place"), F.col("n"), F.col("siblings"))
    rows = rows.withColumn("own", own)
    rows = rows.withColumn("folded", folded(F.col("own"), F.col("top_place"), F.col("top_n"), F.col("top_siblings")))
    proof = F.array_join(F.transform(F.concat("siblings", "top_siblings"), text), "")
    return rows.select(
        F.col("id").alias("doc_id"), text(F.col("node")).alias("leaf"), text(F.col("subroot")).alias("subroot"), text(F.col("root")).alias("root"),
        F.sha2(proof, 256).alias("proof_sha256"), text(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


_FIELD = lambda v: f"coalesce(strlen(({v})::VARCHAR) || ':' || ({v})::VARCHAR, '-')"
_LEAF = lambda n: "sha256(" + " || ".join(_FIELD(v) for v in ("doc_id", "source", "lang", n, "text")) + ")"
#: crc32 bit by bit, over the codes of the id's digits.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))))"""
_TREE = "SELECT g, lv + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {t} WHERE n > 1 GROUP BY g, lv, i // 2, n"
_FOLD = """SELECT f.d, f.g, f.i // 2, f.lv + 1, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN f.i % 2 = 1 THEN s.h || f.h ELSE f.h || s.h END)
  FROM {f} f JOIN {t} me ON me.g = f.g AND me.lv = f.lv AND me.i = f.i AND me.n > 1 LEFT JOIN {t} s ON s.g = f.g AND s.lv = f.lv AND s.i = xor(f.i, 1::BIGINT)"""
_PATH = """SELECT f.d, string_agg(s.h, '' ORDER BY s.lv) AS p FROM {f} f JOIN {t} s ON s.g = f.g AND s.lv = f.lv AND s.i = xor(f.i, 1::BIGINT) GROUP BY f.d"""
SQL = f"""
WITH RECURSIVE
base AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_LEAF("n_chars")} AS leaf,
  CASE WHEN {_CRC} % 7 = 0 THEN {_LEAF("n_chars + 1")} ELSE {_LEAF("n_chars")} END AS changed FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (ORDER BY g, doc_id, leaf) AS d FROM base),
tree(g, lv, i, n, h) AS (SELECT g, 0::BIGINT, i, n, leaf FROM placed UNION ALL {_TREE.format(t="tree")}),
subs AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
top(g, lv, i, n, h) AS (SELECT '', 0::BIGINT, i, n, subroot FROM subs UNION ALL {_TREE.format(t="top")}),
walk(d, g, i, lv, h) AS (SELECT d, g, i, 0::BIGINT, changed FROM placed UNION ALL {_FOLD.format(f="walk", t="tree")}),
upper(d, g, i, lv, h) AS (SELECT w.d, '', s.i, 0::BIGINT, w.h FROM walk w JOIN tree t ON t.g = w.g AND t.lv = w.lv AND t.i = w.i AND t.n = 1 JOIN subs s ON s.g = w.g
  UNION ALL {_FOLD.format(f="upper", t="top")}),
low AS ({_PATH.format(f="walk", t="tree")}), high AS ({_PATH.format(f="upper", t="top")})
SELECT p.doc_id, p.leaf, s.subroot, r.h AS root, sha256(coalesce(low.p, '') || coalesce(high.p, '')) AS proof_sha256, u.h AS folded_root, u.h = r.h AS verified
FROM placed p JOIN subs s ON s.g = p.g JOIN (SELECT h FROM top WHERE n = 1) r ON true JOIN upper u ON u.d = p.d AND u.lv = (SELECT max(lv) FROM top)
LEFT JOIN low ON low.d = p.d LEFT JOIN high ON high.d = p.d"""
