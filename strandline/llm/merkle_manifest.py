"""Merkle manifest of a dataset: a tree of 16 children for each source, a tree over the sources, and proofs.

A leaf is the digest of a row's fields, each behind its length in bytes. Leaves of a source stand in the
order of doc_id; while a tree has more than one node, every 16 consecutive nodes become the digest of their
texts. The node table (tree, level, place, digest) is written once. A proof is looked up in it: from its place
and the size of its group a leaf knows the coordinates of all siblings on its way to the root; they are exploded,
joined to the node table, ordered and concatenated, and the proof is folded over the leaf as it is now.

All leaves of a run of 16 have the same siblings above their run, so those coordinates are exploded once for
a run, and the siblings inside it are the run's own row. Levels of few nodes, which are asked for by very many
runs, go to every executor (counted first); on any other level a node is asked for by a tiny share of all runs.

Nulls: a null field counts as `-`; a null source is the first tree; a null doc_id comes first and is never
tampered with. Rows of one source and doc_id are ordered by their leaves, so rows that are the same throughout have
equal proofs up to their place. An empty table has no root and gives no rows. Very long texts are only
hashed. Other columns are not read. One row: leaf, subroot and root are the same and the proof is empty.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.positions import group_positions
from strandline.runtime import materialize

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of a level that every executor may hold: some 10 MB. On larger levels a node serves one run in 4,000 at most.
BROADCAST_NODES = 65_536
TOP = -1


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _together(digests: Column) -> Column:
    return F.concat_ws("", digests)


def leaf(fields: list[Column]) -> Column:
    """The digest of a row's fields: `-` for null, else the length in bytes, a colon and the value."""
    part = lambda c: F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")))
    return _digest(F.concat(*map(part, fields)))


def leaves(documents: DataFrame, tampered: Column, tampering: Column, text: str = "text") -> DataFrame:
    """doc_id, source, leaf and `now`, the leaf after tampering: `tampering` is the text of rows where `tampered` holds."""
    fields = [F.col(f) for f in FIELDS]
    changed = [tampering if f == text else F.col(f) for f in FIELDS]
    first = documents.select("doc_id", "source", leaf(fields).alias("leaf"), F.when(F.coalesce(tampered, F.lit(False)), leaf(changed)).alias("now"))
    return first.select("doc_id", "source", "leaf", F.coalesce("now", "leaf").alias("now"))


def _levels(most: int) -> int:
    """Levels of a tree of so many leaves above the leaves."""
    out = 0
    while most > 1:
        most, out = -(-most // FAN), out + 1
    return out


def _count(size: Column, level: int) -> Column:
    """Nodes at a level of a tree with `size` leaves."""
    return F.floor((size + (FAN**level - 1)) / FAN**level).cast("long")


def runs_of_leaves(rows: DataFrame) -> DataFrame:
    """tree, run, size, groups, kids: the leaves of each run of 16 in order, one row for each run."""
    placed = group_positions(rows.withColumn("nth", F.monotonically_increasing_id()), "source", ["doc_id", "leaf", "nth"])
    run = F.floor(F.col("place") / FAN).cast("long")
    kids = F.array_sort(F.collect_list(F.struct("place", "doc_id", "leaf", "now")))
    return placed.groupBy(F.col("rank").alias("tree"), run.alias("run"), "size", "groups").agg(kids.alias("kids"))


def _parents(nodes: DataFrame) -> DataFrame:
    """The next level of every tree that still has several nodes."""
    kids = F.array_sort(F.collect_list(F.struct("place", "digest")))
    up = nodes.where("many > 1").groupBy("tree", F.floor(F.col("place") / FAN).cast("long").alias("place"), F.floor((F.col("many") + (FAN - 1)) / FAN).cast("long").alias("many")).agg(kids.alias("kids"))
    return up.select("tree", "place", "many", _digest(_together(F.col("kids.digest"))).alias("digest"))


def node_table(runs: DataFrame, depth: int, heights: int) -> list[tuple[int, bool, DataFrame]]:
    """(level, whether of the tree over sources, nodes) for each level above the leaves, each written.

    `nodes` has tree, place, many (nodes of the tree at this level) and digest.
    """
    alone = F.col("size") == 1
    digest = F.when(alone, F.element_at("kids", 1)["leaf"]).otherwise(_digest(_together(F.col("kids.leaf"))))
    out, now = [], materialize(runs.select("tree", F.col("run").alias("place"), _count(F.col("size"), 1).alias("many"), digest.alias("digest"), "groups"), "merkle-level")
    tops = now.where("many = 1").select("tree", "digest", "groups")
    out.append((1, False, now.drop("groups")))
    for level in range(2, depth + 1):
        now = materialize(_parents(out[-1][2]), "merkle-level")
        tops = tops.unionByName(now.where("many = 1").select("tree", "digest", F.lit(None).cast("long").alias("groups")))
        out.append((level, False, now))
    groups = runs.agg(F.max("groups")).first()[0]
    out.append((0, True, materialize(tops.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(groups).cast("long").alias("many"), "digest"), "merkle-level")))
    for level in range(1, heights + 1):
        out.append((level, True, materialize(_parents(out[-1][2]), "merkle-level")))
    return out


def _steps(depth: int, heights: int) -> list[tuple[bool, int, Column, Column, Column]]:
    """(top, level, tree, place, many) of the nodes on the way of a run to the root, in order."""
    below = [(False, level, F.col("tree"), F.expr(f"run div {FAN ** (level - 1)}"), _count(F.col("size"), level)) for level in range(1, depth)]
    above = [(True, level, F.lit(TOP).cast("long"), F.expr(f"tree div {FAN**level}"), _count(F.col("groups"), level)) for level in range(heights)]
    return below + above


def _siblings(step: int, tree: Column, place: Column, many: Column) -> Column:
    """The coordinates (step, of, place) of the siblings of a node among `many`."""
    start = (place - place % FAN).cast("long")
    run = F.sequence(start, F.greatest(F.least(start + (FAN - 1), many - 1), start))
    return F.transform(F.filter(run, lambda p: p != place), lambda p: F.struct(F.lit(step).alias("step"), tree.alias("of"), p.alias("place")))


def looked_up(runs: DataFrame, nodes: list[tuple[int, bool, DataFrame]], depth: int, heights: int) -> DataFrame:
    """tree, run, siblings: (step, place, digest) of all siblings of a run's way to the root, in order."""
    table = {(top, level): frame for level, top, frame in nodes}
    asked, few, many = [], [], []
    for step, (top, level, tree, place, count) in enumerate(_steps(depth, heights)):
        asked.append(_siblings(step, tree, place, count))
        rows = table[top, level].select(F.lit(step).alias("step"), F.col("tree").alias("of"), "place", "digest")
        (few if table[top, level].count() <= BROADCAST_NODES else many).append((step, rows))
    asks = runs.select("tree", "run", F.explode(F.flatten(F.array(*asked))).alias("ask")).select("tree", "run", "ask.*")
    found = []
    for group, spread in ((few, True), (many, False)):
        if group:
            rows = group[0][1]
            for _, more in group[1:]:
                rows = rows.unionByName(more)
            found.append(asks.where(F.col("step").isin([s for s, _ in group])).join(F.broadcast(rows) if spread else rows, ["step", "of", "place"]))
    both = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return both.groupBy("tree", "run").agg(F.array_sort(F.collect_list(F.struct("step", "place", "digest"))).alias("siblings"))


def proofs(rows: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (all siblings in order), folded_root and verified of every row of `leaves`.

    `rows` should be a written table.
    """
    runs = materialize(runs_of_leaves(rows), "merkle-runs")
    most, groups = runs.agg(F.max("size"), F.max("groups")).first()
    depth, heights = max(_levels(most or 0), 1), _levels(groups or 0)
    nodes = node_table(runs, depth, heights)
    root = nodes[-1][2].select("digest").first()
    steps = _steps(depth, heights)
    if steps:
        ways = looked_up(runs, nodes, depth, heights)
        way = runs.join(ways, ["tree", "run"], "left").withColumn("siblings", F.coalesce("siblings", F.array().cast(ways.schema["siblings"].dataType)))
    else:
        way = runs.withColumn("siblings", F.array().cast("array<struct<step:int,place:bigint,digest:string>>"))

    def side(step: int, place: Column, left: bool) -> Column:
        here = F.filter("siblings", lambda s: (s["step"] == step) & ((s["place"] < place) if left else (s["place"] > place)))
        return _together(F.transform(here, lambda s: s["digest"]))

    def folds(which: list[tuple[int, tuple]]) -> Column:
        each = [F.struct((many > 1).alias("taken"), side(i, place, True).alias("left"), side(i, place, False).alias("right")) for i, (_, _, _, place, many) in which]
        return F.filter(F.array(*each), lambda s: s["taken"]) if each else F.array().cast("array<struct<taken:boolean,left:string,right:string>>")

    fold = lambda start, over: F.aggregate(over, start, lambda x, s: _digest(F.concat(s["left"], x, s["right"])))
    numbered = list(enumerate(steps))
    own = F.when(F.col("size") == 1, F.element_at("kids", 1)["leaf"]).otherwise(_digest(_together(F.col("kids.leaf"))))
    shared = way.select("kids", "size", own.alias("own"), folds([s for s in numbered if not s[1][0]]).alias("below"), folds([s for s in numbered if s[1][0]]).alias("above"), _together(F.col("siblings.digest")).alias("rest"))
    shared = shared.select("kids", "size", "below", "above", "rest", fold(F.col("own"), F.col("below")).alias("subroot"))
    each = shared.select("*", F.posexplode("kids").alias("slot", "kid"))
    left, right = _together(F.slice(F.col("kids.leaf"), 1, F.col("slot"))), _together(F.slice(F.col("kids.leaf"), F.col("slot") + 2, FAN))
    each = each.select("kid.*", "subroot", "below", "above", "size", "rest", left.alias("left"), right.alias("right"))
    first = F.when(F.col("size") == 1, F.col("now")).otherwise(_digest(F.concat("left", "now", "right")))
    folded = fold(fold(first, F.col("below")), F.col("above"))
    done = each.select("doc_id", "leaf", "subroot", F.lit(root[0] if root else None).cast("string").alias("root"), F.concat("left", "right", "rest").alias("proof"), folded.alias("folded_root"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest(documents: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document.

    Tampered rows, those whose doc_id has a crc32 that 5 divides, have their A-Z in lower case.
    """
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    done = proofs(materialize(leaves(documents, tampered, lower), "merkle-leaves"))
    return done.select("doc_id", "leaf", "subroot", "root", _digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def _oracle(depth: int = 6, heights: int = 4) -> str:
    """DuckDB SQL of manifest() for sources of up to 16^depth rows and up to 16^heights sources, level by level."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    hashed = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    parts = [
        # the 256 remainders of the checksum, from its polynomial
        "bytes AS (SELECT list(list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, v) ORDER BY v) AS t FROM range(256) r(v))",
        "ids AS (SELECT *, xor(list_reduce([ascii(x) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')], lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295), 4294967295) % 5 = 0 AS bad FROM documents, bytes)",
        f"leaves AS (SELECT doc_id, source, {hashed('text')} AS leaf, CASE WHEN bad THEN {hashed(lower)} ELSE {hashed('text')} END AS now FROM ids)",
        "l AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, leaf) AS id FROM leaves)",
        "s0 AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY id) - 1 AS place, count(*) OVER (PARTITION BY source) AS many, leaf AS digest, id FROM l)",
        "f0 AS (SELECT l.id, l.source, s0.place, l.now AS x, '' AS proof FROM s0 JOIN l ON s0.id = l.id)",
    ]

    def climb(nodes: str, folds: str, level: int) -> list[str]:
        """Nodes of the next level, and every leaf's fold and proof so far, brought up to it."""
        same = f"n.source IS NOT DISTINCT FROM f.source AND n.place // {FAN} = f.place // {FAN}"
        return [
            f"{nodes}{level + 1} AS (SELECT source, place // {FAN} AS place, (many + {FAN - 1}) // {FAN} AS many, sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM {nodes}{level} WHERE many > 1 GROUP BY ALL)",
            f"{folds}{level + 1} AS (SELECT f.id, any_value(f.source) AS source, any_value(CASE WHEN n.many > 1 THEN f.place // {FAN} ELSE f.place END) AS place,"
            " coalesce(CASE WHEN any_value(n.many) > 1 THEN sha256(string_agg(CASE WHEN n.place = f.place THEN f.x ELSE n.digest END, '' ORDER BY n.place)) END, any_value(f.x)) AS x,"
            " any_value(f.proof) || coalesce(string_agg(CASE WHEN n.place <> f.place THEN n.digest END, '' ORDER BY n.place), '') AS proof"
            f" FROM {folds}{level} f LEFT JOIN {nodes}{level} n ON {same} GROUP BY f.id)",
        ]

    for level in range(depth):
        parts += climb("s", "f", level)
    tops = " UNION ALL ".join(f"SELECT source, digest FROM s{level} WHERE many = 1" for level in range(depth + 1))
    parts += [
        f"subroots AS ({tops})",
        "t0 AS (SELECT CAST(NULL AS VARCHAR) AS source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS many, digest, source AS of FROM subroots)",
        f"g0 AS (SELECT f.id, CAST(NULL AS VARCHAR) AS source, t.place, f.x, f.proof FROM f{depth} f JOIN t0 t ON t.of IS NOT DISTINCT FROM f.source)",
    ]
    for level in range(heights):
        parts += climb("t", "g", level)
    roots = " UNION ALL ".join(f"SELECT digest FROM t{level} WHERE many = 1" for level in range(heights + 1))
    parts.append(f"root AS ({roots})")
    return (
        f"WITH {', '.join(parts)} SELECT l.doc_id, l.leaf, s.digest AS subroot, root.digest AS root, sha256(g.proof) AS proof_sha256, g.x AS folded_root, g.x = root.digest AS verified"
        f" FROM l JOIN g{heights} g ON l.id = g.id JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source, root"
    )


ORACLE = _oracle()
