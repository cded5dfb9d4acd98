"""The Merkle manifest against plain trees, folded witnesses and tampered copies."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tabscope.llm.merkle import Appender, fold, leaf, manifest, proof_text

DDL = "doc_id long, source string, lang string, n_chars long, text string, leaf string, witness int, _g string, `a.b` int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def plain_tree(nodes, fanout):
    """Root and each node's siblings, level by level."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + fanout] for i in range(0, len(nodes), fanout)]
        for i, p in enumerate(place):
            run = runs[p // fanout]
            paths[i].append("".join(run[:p % fanout] + run[p % fanout + 1:]))
            place[i] = p // fanout
        nodes = [sha("".join(r)) for r in runs]
    return nodes[0], ["".join(p) for p in paths]


def plain(rows, fanout):
    """[(doc_id, leaf, subroot, root, proof)] by the definition."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], plain_leaf(r)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs, paths = [], []
    for name in names:
        groups[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        root, path = plain_tree([d for _, d in groups[name]], fanout)
        subs.append(root)
        paths.append(path)
    root, top = plain_tree(subs, fanout)
    return sorted((k or -1, d, s, root, sha(p + t)) for name, s, path, t in zip(names, subs, paths, top)
                  for (k, d), p in zip(groups[name], path))


def rows_of(n):
    out = [(i, f"s{i % 3}", "en", i, f"Text {i}", "x", 1, "y", 2) for i in range(n)]
    out += [(i, "hot", None, None, None, "x", 1, "y", 2) for i in range(3 * n)]
    out += [(7, "hot", "en", 1, "É same", "x", 1, "y", 2)] * 5 + [(None, None, None, None, "", None, None, None, None)] * 3
    return out + [(None, "hot", None, 1, "a" * 100_000, None, 1, None, 1), (1, "", None, None, "empty name", None, None, None, None),
                  (2, "\U0001F600", None, None, "x", None, None, None, None), (3, "￮", None, None, "x", None, None, None, None)]


@pytest.mark.parametrize("fanout,block_levels,n", [(2, 1, 9), (3, 2, 40), (16, 3, 30), (2, 2, 1)])
def test_manifest_equals_plain_tree(spark, fanout, block_levels, n):
    rows = rows_of(n)
    out = manifest(spark.createDataFrame(rows, DDL).repartition(7), fanout=fanout, block_levels=block_levels,
                   claims={"copy": leaf(("doc_id", "source", "lang", "n_chars", "text"))})
    out = out.withColumn("proof", F.sha2(proof_text(F.col("witness")), 256)).withColumn("folded", fold(F.col("copy"), F.col("witness")))
    got = out.collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id or -1, r.leaf, r.subroot, r.root, r.proof) for r in got) == plain(rows, fanout)
    assert all(r.folded == r.root for r in got)


def test_tampering_shows(spark):
    df = spark.createDataFrame(rows_of(20), DDL)
    copy = leaf(("doc_id", "source", "lang", "n_chars", "text"), {"text": F.lower("text")})
    got = manifest(df, fanout=3, block_levels=1, claims={"copy": copy}).withColumn("folded", fold(F.col("copy"), F.col("witness"))).collect()
    assert any(r.copy == r.leaf for r in got) and any(r.copy != r.leaf for r in got)
    assert all((r.folded == r.root) == (r.copy == r.leaf) for r in got)


def test_empty_and_one(spark):
    assert manifest(spark.createDataFrame([], DDL)).count() == 0
    one = manifest(spark.createDataFrame(rows_of(0)[-1:], DDL)).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root and one[0].witness == []


def test_witnesses_are_extended_by_appends():
    tree = Appender(2, 2)
    tree.append("a")
    assert tree.witness[0] == [{"left": "", "right": ""}]
    tree.append("b")
    assert tree.witness[0][0] == {"left": "", "right": "b"} and tree.witness[1][0] == {"left": "a", "right": ""}
    tree.append("c")
    assert tree.finish() == sha(sha("ab") + sha("c")) and tree.witness[0][1] == {"left": "", "right": sha("c")}
