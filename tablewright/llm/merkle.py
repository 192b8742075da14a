"""Merkle manifest of a dataset, with proofs found by pointer jumping.

A leaf is the digest of a row's fields. The leaves of a group (a language) are numbered by their
key and paired up to the group's subroot; the subroots are paired up to one root in the same
way. Numbers come from sorted ranges, and ten levels are built per shuffle from runs of
1,024 neighbours, so no task holds more than that of a group.

A node knows one sibling and points to its parent. A self-join replaces a pointer by the
pointer of the node it leads to and joins their sibling segments, so the distance doubles. After
round k only nodes whose level is a multiple of 2^k can still be met, the others are left out:
the rows are the leaves and some of the nodes, and the rounds are the logarithm of the height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import fresh, numbered, stored, table

#: levels that one shuffle builds: a run of 2^LEVELS digests is an array of one row
LEVELS = 10
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: bytes of a level in a segment: 1 (sibling on the left), 2 (on the right) or 0 (none), then the digest or zeros
STEP = 33
TAMPERED_EVERY = 7


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the encoded fields one after another."""
    return F.sha2(F.concat(*[encoded(f) for f in fields]), 256)


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _parent(left: Column, right: Column) -> Column:
    """Digest of the hex text of one or two digests; ``right`` is null for one."""
    return F.unhex(F.sha2(F.concat(_hex(left), F.coalesce(_hex(right), F.lit(""))), 256))


def _at_top(n: Column, level: Column) -> Column:
    """Whether the level holds the one root of a tree of n leaves."""
    return F.call_function("shiftright", n - 1, level) == 0


def _half(level: Column) -> Column:
    """The parents of an array of digests."""
    count = F.ceil(F.size(level) / 2).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: _parent(F.get(level, 2 * i), F.get(level, 2 * i + 1)))


def tree(leaves: DataFrame) -> DataFrame:
    """All nodes (tree, n, level, place, digest) over leaves (tree, n, place, digest).

    ``n`` is the number of leaves of the tree and ``place`` counts a level's nodes from 0. Trees
    end at the level that has one node; a lone leaf is its own tree.
    """
    base = leaves.select("tree", "n", F.lit(0).alias("level"), "place", "digest")
    whole, level, most = base, 0, leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        runs = base.groupBy("tree", "n", F.shiftright("place", LEVELS).alias("run")).agg(
            F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("held")
        )
        up = F.aggregate(
            F.sequence(F.lit(1), F.lit(LEVELS)), F.array(F.col("held.digest")),
            lambda levels, _: F.concat(levels, F.array(_half(F.element_at(levels, -1)))),
        )
        # a level exists while the one below has more than one node in the whole tree
        grown = runs.select("tree", "n", "run", F.posexplode(up).alias("i", "digests")).where(
            (F.col("i") > 0) & (F.call_function("shiftright", F.col("n") - 1, F.col("i") - 1 + level) > 0)
        )
        made = stored(
            grown.select("tree", "n", "run", "i", F.posexplode("digests").alias("k", "digest")).select(
                "tree", "n", (F.col("i") + level).alias("level"),
                (F.call_function("shiftleft", F.col("run"), LEVELS - F.col("i")) + F.col("k")).alias("place"), "digest",
            ),
            "levels",
        )
        whole = whole.unionByName(made)
        level += LEVELS
        most = -(-most // (1 << LEVELS))
        base = made.where(F.col("level") == level)
    return whole


def proofs(leaves: DataFrame) -> DataFrame:
    """Leaves (tree, n, place, digest) with ``segment``, the siblings up to their tree's root, and ``top``, that root.

    A segment is binary, STEP bytes for each level.
    """
    nodes = stored(tree(leaves), "nodes")
    sides = nodes.select(
        "tree", "n", "level", "place", "digest",
        F.shiftright("place", 1).alias("pair"), (F.col("place").bitwiseAND(F.lit(1)) == 1).alias("odd"),
    )
    pairs = sides.groupBy("tree", "n", "level", "pair").agg(
        F.max(F.when(~F.col("odd"), F.col("digest"))).alias("first"), F.max(F.when(F.col("odd"), F.col("digest"))).alias("second")
    )
    top = _at_top(F.col("n"), F.col("level"))
    right = F.coalesce(F.concat(F.lit(b"\x02"), F.col("second")), F.lit(bytes(STEP)))
    ends = F.array(
        F.struct((2 * F.col("pair")).alias("place"), F.col("first").alias("digest"), right.alias("segment")),
        F.struct((2 * F.col("pair") + 1).alias("place"), F.col("second").alias("digest"), F.concat(F.lit(b"\x01"), F.col("first")).alias("segment")),
    )
    step = pairs.select("tree", "n", "level", F.explode(ends).alias("e")).where(F.col("e.digest").isNotNull()).select(
        "tree", "level", "e.place", "e.digest", F.when(top, F.lit(0)).otherwise(1).alias("reach"),
        F.when(top, F.lit(b"")).otherwise(F.col("e.segment")).alias("segment"),
    )
    # reach is the distance to the node that the pointer leads to; at the root it is 0 and the segment is empty
    held = stored(step, "pointers")
    most, height = leaves.agg(F.max("n")).first()[0] or 1, 0
    while 1 << height < most:
        height += 1
    jump = 1
    while jump < height:
        movers = held.where(F.col("level") % (2 * jump) == 0)
        met = held.where(F.col("level") % (2 * jump) == jump).select(
            F.col("tree").alias("tree_"), F.col("level").alias("level_"), F.col("place").alias("place_"),
            F.col("reach").alias("reach_"), F.col("segment").alias("segment_"),
        )
        # a pointer that stopped early stands on a root, which has nothing to add
        moving = movers.where(F.col("reach") == jump).withColumn("at", F.shiftright("place", jump)).join(
            met,
            (F.col("tree") == F.col("tree_")) & (F.col("level") + jump == F.col("level_")) & (F.col("at") == F.col("place_")),
        ).select(
            "tree", "level", "place", "digest", (F.col("reach") + F.col("reach_")).alias("reach"),
            F.concat("segment", "segment_").alias("segment"),
        )
        held = stored(moving.unionByName(movers.where(F.col("reach") != jump)), "pointers")
        jump *= 2
    roots = nodes.where(_at_top(F.col("n"), F.col("level"))).select(F.col("tree").alias("tree_"), F.col("digest").alias("top"))
    return held.where(F.col("level") == 0).join(stored(roots, "roots"), F.col("tree") == F.col("tree_")).select(
        "tree", "place", "digest", "segment", "top"
    )


def _steps(segment: Column) -> Column:
    """The records of a segment as an array."""
    count = F.floor(F.length(segment) / STEP).cast("int")
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substring(segment, i * STEP + 1, F.lit(STEP)))


def folded(digest: Column, segment: Column) -> Column:
    """The root that a leaf and its siblings lead to."""

    def up(node, step):
        side, sibling = F.substring(step, 1, 1), _hex(F.substring(step, 2, STEP - 1))
        before = F.when(side == F.lit(b"\x01"), sibling).otherwise("")
        after = F.when(side == F.lit(b"\x02"), sibling).otherwise("")
        return F.unhex(F.sha2(F.concat(before, _hex(node), after), 256))

    return F.aggregate(_steps(segment), digest, up)


def proof_digest(segment: Column) -> Column:
    """Lowercase hex SHA-256 of the siblings' hex text, from the leaf to the root."""
    some = F.filter(_steps(segment), lambda s: F.substring(s, 1, 1) != F.lit(b"\x00"))
    return F.sha2(F.concat_ws("", F.transform(some, lambda s: _hex(F.substring(s, 2, STEP - 1)))), 256)


def manifest(docs: DataFrame, fields: list[str], key: str = "doc_id", group: str = "lang") -> DataFrame:
    """Every row's ``fields`` replaced by leaf, subroot, root (hex) and segment, its proof; other columns stay.

    ``segment`` has STEP bytes for each level from the leaf to the root: 1 and the digest of the left
    sibling, 2 and that of the right one, or zeros where a node has none. Within a group leaves stand by ``key`` (null first) and, where keys
    are equal, by digest; groups by their name as UTF-8 bytes (null first, a group of its own).
    Fields may be null or empty; equal rows are leaves of their own with the same digest. New
    columns whose name is taken get a leading underscore. An empty table gives an empty one.
    """
    own = [c for c in docs.columns if c not in fields or c in (key, group)]
    base = docs.select(
        *[F.col(c).alias(f"own{i}") for i, c in enumerate(own)], F.col(key).alias("key"), F.col(group).alias("group"),
        F.unhex(leaf_digest([F.col(f) for f in fields])).alias("digest"),
    )
    placed = stored(numbered(base, [F.col("group").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("digest")], "at"), "leaves")
    # one row for each group; its number is its place among the groups
    groups = placed.groupBy("group").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    groups = stored(numbered(groups, [F.col("group").asc_nulls_first()], "tree"), "groups")
    leaves = stored(placed.join(groups.withColumnRenamed("group", "of"), F.col("group").eqNullSafe(F.col("of"))).select(
        "tree", "n", (F.col("at") - F.col("first")).alias("place"), "digest", "at"
    ), "places")
    low = proofs(leaves.drop("at"))
    roots = low.groupBy("tree").agg(F.max("top").alias("digest"))
    total = groups.count()
    high = proofs(stored(roots.select(F.lit(0).cast("long").alias("tree"), F.lit(total).cast("long").alias("n"), F.col("tree").alias("place"), "digest"), "subroots"))
    # the last jump leads from the subroots to the root: one row for each group
    last = stored(high.select(F.col("place").alias("tree_"), F.col("segment").alias("segment_"), F.col("top").alias("root")), "last")
    firsts = groups.select(F.col("tree").alias("tree__"), "first")
    whole = low.join(last, F.col("tree") == F.col("tree_")).join(firsts, F.col("tree") == F.col("tree__")).select(
        (F.col("first") + F.col("place")).alias("at"), "top", "root", F.concat("segment", "segment_").alias("segment")
    )
    names = {}
    for n in ("leaf", "subroot", "root", "segment"):
        names[n] = fresh([*own, *names.values()], n)
    return placed.join(whole, "at").select(
        *[F.col(f"own{i}").alias(c) for i, c in enumerate(own)], _hex(F.col("digest")).alias(names["leaf"]),
        _hex(F.col("top")).alias(names["subroot"]), _hex(F.col("root")).alias(names["root"]), F.col("segment").alias(names["segment"]),
    )


def verified(proofs_of: DataFrame, leaf: Column, segment: str = "segment", root: str = "root") -> DataFrame:
    """The rows with folded_root, what ``leaf`` (hex) and the segment lead to, and verified, whether that is the root."""
    folded_name = fresh(proofs_of.columns, "folded_root")
    name = fresh([*proofs_of.columns, folded_name], "verified")
    found = proofs_of.withColumn(folded_name, _hex(folded(F.unhex(leaf), F.col(segment))))
    return found.withColumn(name, F.col(folded_name) == F.col(root))


def op13_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    hit = F.crc32(F.col("doc_id").cast("string")) % TAMPERED_EVERY == 0
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    changed = leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), more, F.col("text")])
    whole = manifest(docs.withColumn("tampered", F.when(hit, changed)), FIELDS)
    found = verified(whole, F.coalesce("tampered", "leaf"))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("segment")).alias("proof_sha256"), "folded_root", "verified")


QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}

#: the bytes' table of CRC-32 (reflected polynomial)
_CRC_TABLE = (
    "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), "
    "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END))"
)


def crc_sql(text: str, table_name: str) -> str:
    """The unsigned CRC-32 of an ASCII text; ``table_name`` is a column with the bytes' table."""
    return (
        f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), "
        f"lambda ch: ascii(ch)::BIGINT)), lambda acc, b: xor({table_name}[(xor(acc, b) & 255) + 1], acc >> 8)))"
    )


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


ORACLES = {"op13_merkle_manifest": f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS bytes),
rows_ AS MATERIALIZED (
    SELECT doc_id, lang, {_field('doc_id')} || {_field('source')} || {_field('lang')} AS head,
        n_chars, text, coalesce({crc_sql('doc_id::VARCHAR', 'bytes')} % {TAMPERED_EVERY} = 0, false) AS hit
    FROM documents, crc
),
leaves AS MATERIALIZED (
    SELECT doc_id, lang, sha256(head || {_field('n_chars')} || {_field('text')}) AS leaf,
        sha256(head || {_field("(n_chars + CASE WHEN hit THEN 1 ELSE 0 END)")} || {_field('text')}) AS changed
    FROM rows_
),
placed AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
        dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree
    FROM leaves
),
low AS (
    SELECT tree, 0 AS level, place, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM placed
    UNION ALL
    SELECT tree, level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (max(n) + 1) // 2
    FROM low WHERE n > 1 GROUP BY tree, level, place // 2
),
lows AS MATERIALIZED (SELECT * FROM low),
subroots AS MATERIALIZED (SELECT tree, digest FROM lows WHERE n = 1),
high AS (
    SELECT 0 AS level, tree AS place, digest, count(*) OVER () AS n FROM subroots
    UNION ALL
    SELECT level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (max(n) + 1) // 2
    FROM high WHERE n > 1 GROUP BY level, place // 2
),
highs AS MATERIALIZED (SELECT * FROM high),
depth AS MATERIALIZED (SELECT tree, max(level) AS level FROM lows GROUP BY tree),
nodes AS MATERIALIZED (
    SELECT tree, level, place, digest FROM lows
    UNION ALL SELECT -1, level, place, digest FROM highs
),
climb AS (
    SELECT p.tree AS of, p.place AS leaf_place, p.tree AS tree, 0 AS level, p.place AS place, '' AS siblings,
        p.leaf AS node, p.changed AS folded
    FROM placed p
    UNION ALL
    SELECT c.of, c.leaf_place,
        CASE WHEN c.level = coalesce(d.level, -1) THEN -1 ELSE c.tree END,
        CASE WHEN c.level = coalesce(d.level, -1) THEN 0 ELSE c.level + 1 END,
        CASE WHEN c.level = coalesce(d.level, -1) THEN c.of ELSE c.place // 2 END,
        CASE WHEN c.level = coalesce(d.level, -1) THEN c.siblings ELSE c.siblings || coalesce(s.digest, '') END,
        c.node,
        CASE WHEN c.level = coalesce(d.level, -1) THEN c.folded
            WHEN c.place % 2 = 1 THEN sha256(s.digest || c.folded) ELSE sha256(c.folded || coalesce(s.digest, '')) END
    FROM climb c
    LEFT JOIN depth d ON d.tree = c.tree
    LEFT JOIN nodes s ON s.tree = c.tree AND s.level = c.level AND s.place = xor(c.place, 1)
    WHERE c.tree >= 0 OR c.level < (SELECT max(level) FROM highs)
)
SELECT p.doc_id, p.leaf, r.digest AS subroot, (SELECT digest FROM highs WHERE n = 1) AS root,
    sha256(c.siblings) AS proof_sha256, c.folded AS folded_root, c.folded = (SELECT digest FROM highs WHERE n = 1) AS verified
FROM placed p
JOIN subroots r USING (tree)
JOIN climb c ON c.of = p.tree AND c.leaf_place = p.place AND c.tree = -1 AND c.level = (SELECT max(level) FROM highs)
"""}
