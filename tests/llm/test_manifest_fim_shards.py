"""Merkle manifest, fill-in-the-middle and Hilbert shards against plain loops, on tables full of edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from strandline.llm import fill_in_middle, merkle_manifest, registry, sharding
from strandline.operators.positions import group_positions

DOCS = "doc_id long, text string, lang string, source string, n_chars long, place int, nth int, curve int, size string, tree string, output string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows():
    rng = random.Random(3)
    texts = [None, "", " ", "\n\t ", "one", " one", "one ", "a <P> b", "a<S", "P>", "Ünï cödé 漢字 text", "A B C D", "x" * 5000, "word " * 3000, "\x85 \xa0 not blank"]
    out = [(i, texts[i % len(texts)], rng.choice([None, "aa", "bb"]), None if i % 9 == 0 else "hot" if i % 2 else f"s{rng.randrange(30):02d}", None if i % 7 == 0 else i, 1, 2, 3, "clash", "clash", "clash") for i in range(700)]
    out += [(None, "Null Id", "aa", "hot", 1, 1, 2, 3, "", "", "")] * 2 + [(5, "other TEXT", "aa", "alone", 1, 1, 2, 3, "", "", "")] + [out[11]] * 40
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(5)


# merkle manifest --------------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def climb(levels, place, now):
    siblings = []
    for level in levels[:-1]:
        first = place - place % 16
        run = level[first : first + 16]
        siblings += run[: place - first] + run[place - first + 1 :]
        now = digest(*run[: place - first], now, *run[place - first + 1 :])
        place //= 16
    return siblings, now


def plain_manifest(table):
    by_source = {}
    for row in table:
        by_source.setdefault(row[3], []).append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees, kept = {}, {}
    for source in order:
        kept[source] = sorted(by_source[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[source] = tree([leaf(r, r[1]) for r in kept[source]])
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for at, source in enumerate(order):
        for place, row in enumerate(kept[source]):
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            now = leaf(row, row[1].translate(LOWER) if bad and row[1] is not None else row[1])
            below, now = climb(trees[source], place, now)
            above, now = climb(top, at, now)
            out.append((row[0], leaf(row, row[1]), trees[source][-1][0], top[-1][0], digest(*below, *above), now, now == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast", [65_536, 3, 0])
def test_manifest(docs, monkeypatch, broadcast):
    """With small levels sent to every executor, with large and small ones, and with none."""
    monkeypatch.setattr(merkle_manifest, "BROADCAST_NODES", broadcast)
    got = sorted((tuple(r) for r in merkle_manifest.manifest(docs).collect()), key=repr)
    assert got == plain_manifest(rows())
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_few_rows(spark):
    for table in (rows()[:1], rows()[:17], [rows()[1]] * 3):
        got = sorted((tuple(r) for r in merkle_manifest.manifest(spark.createDataFrame(table, DOCS)).collect()), key=repr)
        assert got == plain_manifest(table)
    assert merkle_manifest.manifest(spark.createDataFrame([], DOCS)).collect() == []


def test_group_positions(spark, docs):
    got = group_positions(docs.select("doc_id", "source"), "source", ["doc_id"], parts=7).collect()
    sources = sorted({r.source for r in got}, key=lambda s: (s is not None, s or ""))
    for source in sources:
        own = sorted((r.place, r.doc_id is not None, r.doc_id or 0) for r in got if r.source == source)
        assert [p for p, *_ in own] == list(range(len(own))) and [x for _, *x in own] == sorted(x for _, *x in own)
        assert {(r.size, r.rank, r.groups) for r in got if r.source == source} == {(len(own), sources.index(source), len(sources))}


# fill in the middle -----------------------------------------------------------------------

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_fim(key, text):
    text = text or ""
    tokens = UNITS.findall(text)
    h = [int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    pre, mid, suf = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(tokens), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(tokens), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle(spark, docs):
    wanted = [(r[0], *plain_fim(r[0], r[1])) for r in rows()]
    done = fill_in_middle.transform(docs)
    got = [tuple(r) for r in done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    assert done.drop("n", "form", "prefix_chars", "middle_chars", "output").columns == [c for c in docs.columns if c != "output"]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digests = [tuple(r) for r in fill_in_middle.digests(docs).collect()]
    assert sorted(digests, key=repr) == sorted(((r[0], *plain_fim(r[0], r[1])[:4], sha(plain_fim(r[0], r[1])[4]), sha(r[1] or "")) for r in rows()), key=repr)
    assert fill_in_middle.transform(spark.createDataFrame([], DOCS)).count() == 0


def test_kernel_over_random_texts():
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab é<P>SM \n\t漢") for _ in range(rng.randrange(30))) for _ in range(500)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([0] + [len(t.encode()) for t in texts])
    first, second = (np.array([rng.randrange(1 << 32) for _ in texts]) for _ in range(2))
    n, low, high = fill_in_middle.cuts(data, ends, first, second)
    assert fill_in_middle.has_sentinel(data, ends).tolist() == [bool(re.search("<[PSM]>", t)) for t in texts]
    for i, text in enumerate(texts):
        tokens = UNITS.findall(text)
        a, b = sorted((first[i] % (len(tokens) + 1), second[i] % (len(tokens) + 1)))
        assert (n[i], low[i] - ends[i], high[i] - ends[i]) == (len(tokens), len("".join(tokens[:a]).encode()), len("".join(tokens[:b]).encode()))


# shards -----------------------------------------------------------------------------------


def test_hilbert_index_walks_every_cell(spark):
    """Neighbours on the curve are neighbours in the grid, and each cell has one place."""
    for n, bits in ((2, 3), (3, 2), (4, 2)):
        side = 1 << bits
        cells = spark.range(side**n).select(*(F.expr(f"cast(id div {side**i} % {side} as int)").alias(f"x{i}") for i in range(n)))
        walked = cells.select("*", sharding.hilbert_index([F.col(f"x{i}") for i in range(n)], bits).alias("at")).orderBy("at").collect()
        assert [r.at for r in walked] == list(range(side**n))
        assert all(sum(abs(a[i] - b[i]) for i in range(n)) == 1 for a, b in zip(walked, walked[1:]))


def test_shards(spark, docs):
    got = sharding.shard_rows(docs).collect()
    sizes = [sum(r.shard == s for r in got) for s in range(40)]
    assert sum(sizes) == len(rows()) and max(sizes) - min(sizes) <= 1
    for s in range(40):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    order = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    key = lambda t: (repr(t[0]), t[1], t[2])
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=key) == sorted(((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows()), key=key)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    few = sharding.shard_rows(docs.limit(7)).collect()
    assert len({r.shard for r in few}) == 7 and {r.slot for r in few} == {0}
    assert sharding.shard_rows(spark.createDataFrame([], DOCS)).count() == 0


def test_shard_files_prune(spark, tmp_path):
    """Written shards hold the rows in order, and their zones leave more files unread than an order by id alone."""
    table = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("concat('s', id % 8)").alias("source"), F.expr("concat('l', (id div 8) % 4)").alias("lang"), (F.xxhash64("id") % 500 + 500).alias("size"), F.crc32(F.col("id").cast("string")).alias("text_crc32"))
    table.write.parquet(f"{tmp_path}/in")
    assigned = sharding.assign(spark.read.parquet(f"{tmp_path}/in"), shards=32)
    sharding.write_shards(assigned, f"{tmp_path}/out", file_rows=50)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, back.select("shard", "slot", "doc_id").collect())) == sorted(map(tuple, assigned.select("shard", "slot", "doc_id").collect()))
    for wanted in ("min_source <= 's3' AND max_source >= 's3'", "min_lang <= 'l2' AND max_lang >= 'l2'", "min_doc_id <= 700"):
        assert sharding.pruned_share(sharding.zone_map(back, ["source", "lang", "doc_id"]), F.expr(wanted)) >= 0.4
    in_id_order = table.withColumn("shard", F.expr("doc_id div 125"))
    assert sharding.pruned_share(sharding.zone_map(in_id_order, ["source", "lang"]), F.expr("min_source <= 's3' AND max_source >= 's3'")) == 0


def test_registered_queries_have_sql():
    assert {"op11_merkle_manifest", "op12_fill_in_middle", "op13_hilbert_shards"} <= set(registry.queries()) & set(registry.oracle_sql())
