"""The registered queries of the training-data operators, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, read_table
from .encode import vocabulary

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return keep


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(*(cols or ("doc_id", "text")))


@query("op5_wavelet_tokens")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wavelet import round_trip
    docs = round_trip(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end_id=2)
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack
    pieces = pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), window=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


OP2_SQL = """
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN CAST([] AS VARCHAR[]) ELSE regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') END AS w
    FROM documents),
b AS (SELECT item_id, regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS g
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
    FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT dw.doc_id, dw.k, dw.i, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n, 0) AS n_items,
    sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query("op2_decontamination", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination
    out = contamination(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score
    out = score(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"), "quality", folds=5, held_out=0)
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score",
                      (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score
    out = score(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"), "toxic", folds=3, held_out=1)
    score = F.col("toxicity_score")
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), score.alias("score"),
                      (score >= 0.7).cast("int").alias("predicted"))


@query("op1_language")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify, train
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = train(docs.where(crc_mod("doc_id", 4) != 2))
    out = identify(docs, model)
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


OP10_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 3], ' ')) AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
f AS (SELECT g, count(*) AS c FROM s GROUP BY 1 HAVING count(*) > 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN f USING (g) JOIN s b USING (g)
    WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * p.i >= 80 * (a.n + b.n - p.i)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT DISTINCT x AS node, x AS root FROM l
    UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.node),
c AS (SELECT node, min(root) AS root FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id,
    d.doc_id = coalesce(c.root, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id
"""


@query("op10_minhash_neardup", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates
    return near_duplicates(documents(spark, sf_dir), shingle=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


@query("op6_suffix_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import remove_repeats
    out = remove_repeats(documents(spark, sf_dir), length=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = """
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN CAST([] AS VARCHAR[])
      ELSE regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') END AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
f AS (SELECT g FROM s GROUP BY 1 HAVING count(*) > 1),
h AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM s JOIN f USING (g))),
r AS (SELECT doc_id, count(*) AS n_removed, list(p) AS gone FROM h GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
    sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN (
    SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept FROM (
      SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) t
    WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = t.doc_id AND h.p = t.p) GROUP BY 1) k USING (doc_id)
"""


@query("op8_lz_dedup", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .factors import remove_repeated_words
    out = remove_repeated_words(documents(spark, sf_dir), length=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op3_nn_descent")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest
    return nearest(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), every=20, k=20)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# crc32 of ASCII text: the table of a byte's remainders, then one step a byte
CRC_TABLE = """(SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384)
    ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"""


def crc32_sql(text: str, table: str) -> str:
    return f"""xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS BIGINT))),
      lambda c, b: xor(c >> 8, {table}[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295)"""


def _tree_sql(name: str, levels: int = 6) -> str:
    """Tables {name}1 .. {name}{levels}: nodes (g, p, d, n) a level up; {name}s0 ..: the siblings of each node.

    n counts a group's nodes; a group of one node stays as it is.  Six levels hold 16.7 million leaves a group.
    """
    out = []
    for i in range(levels):
        out.append(f"""{name}s{i} AS (SELECT g, p, d, n, n > 1 AS inner_node,
            coalesce(string_agg(d, '') OVER (PARTITION BY g, p // 16 ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
            coalesce(string_agg(d, '') OVER (PARTITION BY g, p // 16 ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
            FROM {name}{i})""")
        out.append(f"""{name}{i + 1} AS (SELECT g, p // 16 AS p, CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY p)) ELSE max(d) END AS d,
            (n + 15) // 16 AS n FROM {name}{i} GROUP BY g, p // 16, n)""")
    return ",\n".join(out)


def _op13_sql(levels: int = 6) -> str:
    def leaf(text):
        return "sha256(" + " || ".join(f"coalesce(CAST(strlen({c}) AS VARCHAR) || ':' || {c}, '-')" for c in
                                       ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"
    steps = []
    for tree, key, at in (("s", "g", "p"), ("t", "'x'", "gp")):
        for i in range(levels):
            source = f"f{len(steps)}"
            steps.append(f"""f{len(steps) + 1} AS (SELECT f.* REPLACE (CASE WHEN inner_node THEN sha256(l || f.claim || r) ELSE f.claim END AS claim,
                CASE WHEN inner_node THEN f.proof || l || r ELSE f.proof END AS proof)
                FROM {source} f JOIN {tree}s{i} x ON x.g = f.{key} AND x.p = f.{at} // CAST(16 ** {i} AS BIGINT))""".replace("f.'x'", "'x'"))
    return f"""
WITH crc AS {CRC_TABLE},
a AS (SELECT doc_id, coalesce('g' || source, '') AS g, {leaf("text")} AS d,
    CASE WHEN doc_id IS NOT NULL AND {crc32_sql("CAST(doc_id AS VARCHAR)", "crc.t")} % 5 = 0
      THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {leaf("text")} END AS claim FROM documents, crc),
b AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM a),
s0 AS (SELECT g, p, d, n FROM b),
{_tree_sql("s", levels)},
t0 AS (SELECT 'x' AS g, row_number() OVER (ORDER BY g) - 1 AS p, d, count(*) OVER () AS n, g AS name FROM s{levels}),
{_tree_sql("t", levels)},
f0 AS (SELECT b.doc_id, b.g, b.p, b.d AS leaf, b.claim, '' AS proof, t0.d AS subroot, t0.p AS gp FROM b JOIN t0 ON t0.name = b.g),
{", ".join(steps)}
SELECT doc_id, leaf, subroot, root.d AS root, sha256(proof) AS proof_sha256, claim AS folded_root, claim = root.d AS verified
FROM f{len(steps)}, t{levels} AS root
"""


@query("op13_merkle_manifest", _op13_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import FIELDS, fold, leaf, manifest, proof_text
    docs = read_table(spark, sf_dir, "documents").select(*FIELDS)
    tampered = F.col("doc_id").isNotNull() & (crc_mod("doc_id", 5) == 0)
    copy = leaf(FIELDS, {"text": F.when(tampered, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))})
    out = manifest(docs, claims={"copy": copy})
    out = out.withColumn("folded_root", fold(F.col("copy"), F.col("witness")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("witness")), 256).alias("proof_sha256"),
                      "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _op12_sql() -> str:
    def least(*ways):
        return f"list_min(list_filter([{', '.join(ways)}], lambda x: x.c IS NOT NULL))"

    def way(cost, letter, line, rest, when="true"):
        line = "''" if line is None else f"chr(10) || {line}"
        return (f"CASE WHEN {when} THEN {{'c': {cost} + {rest}.c, 'a': '{letter}' || {rest}.a, 'r': {line} || {rest}.r}} "
                f"ELSE {{'c': CAST(NULL AS INTEGER), 'a': '', 'r': ''}} END")
    stay = "fault IN (0, 3)"
    more = "CASE WHEN fault = 3 THEN 3 ELSE 0 END"
    g = {}
    for q, (due, role) in {"n": ("u", "user"), "s": ("u", "user"), "u": ("a", "assistant"), "a": ("u", "user")}.items():
        keep = {"n": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}[q]
        g[q] = least(way(4, "D", None, f"f.{q}"), way(f"3 + {more}", "R", f"'{role}:' || m.text", f"f.{due}", stay),
                     *[way(more, "K", "m.role || ':' || m.text", f"f.{k}", f"{stay} AND left(m.role, 1) = '{k}'") for k in keep])

    def struct(c, a, r):
        return f"{{'c': {c}, 'a': '{a}', 'r': {r}}}"
    user, both = "chr(10) || 'user:'", "chr(10) || 'user:' || chr(10) || 'assistant:'"
    ins = {q: least(f"gn.{q}", way(3, "I", "'user:'", "gn.u"), f"{{'c': 6 + gn.a.c, 'a': 'II' || gn.a.a, 'r': {both} || gn.a.r}}") for q in ("n", "s")}
    ins["u"] = least("gn.u", way(3, "I", "'assistant:'", "gn.a"))
    ins["a"] = least("gn.a", way(3, "I", "'user:'", "gn.u"))
    return f"""
WITH RECURSIVE crc AS {CRC_TABLE},
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))", "crc.t")} % 20 AS k FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM o, range(2) copies(copy) WHERE k <> 0 AND (copy = 0 OR k = 3)),
e AS (SELECT *, coalesce('c' || CAST(conv_id AS VARCHAR), '') AS g, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS z,
    md5(CAST(strlen(role) AS VARCHAR) || ':' || role || text) AS h FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, h) AS i FROM e),
m AS (SELECT *, CASE WHEN z = '' THEN 1 WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 2
      WHEN z NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    coalesce(lag(left(role, 1)) OVER (PARTITION BY g ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS odd FROM p),
f AS (SELECT g, max(i) + 1 AS i, {struct(0, "", "''")} AS n, {struct(6, "II", both)} AS s,
      {struct(3, "I", "chr(10) || 'assistant:'")} AS u, {struct(0, "", "''")} AS a FROM m GROUP BY g
    UNION ALL
    SELECT g, i, {ins["n"]} AS n, {ins["s"]} AS s, {ins["u"]} AS u, {ins["a"]} AS a FROM (
      SELECT m.g AS g, m.i AS i, {g["n"]} AS n, {g["s"]} AS s, {g["u"]} AS u, {g["a"]} AS a
      FROM f JOIN m ON m.g = f.g AND m.i = f.i - 1) gn),
c AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum((fault = 1)::INT) AS blank,
    sum((fault = 2)::INT) AS duplicate, sum((fault = 3)::INT) AS truncated, sum(odd::INT) AS illegal FROM m GROUP BY g)
SELECT x.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
    CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
    CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(f.n.c, 0) AS BIGINT) AS cost, coalesce(f.n.a, '') AS audit,
    sha256(coalesce(substr(f.n.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('c' || CAST(conv_id AS VARCHAR), '') AS g FROM conversations) x
LEFT JOIN c USING (g) LEFT JOIN f ON f.g = x.g AND f.i = 1
"""


@query("op12_conversation_repair", _op12_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import damaged, group_key, repair, report
    convs = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = report(repair(damaged(convs)))
    ids = convs.select("conv_id").distinct().withColumn("_g", group_key("conv_id")).join(out, "_g", "left")
    return ids.select("conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in
                                   ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@query("op11_class_lm")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .classlm import class_scores
    out = class_scores(documents(spark, sf_dir), crc_mod("doc_id", 7) != 2)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
