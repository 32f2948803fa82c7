"""Registry of queries and their DuckDB SQL, and the tables derived from the given ones that they run on."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# SQL that Spark and DuckDB both run; {G} is DuckDB's option for replacing all matches.
FIXTURES = {
    "fx_gt": """SELECT l_orderkey AS image_id, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS gt_id, l_linenumber % 2 AS cls,
        (l_partkey % 40) * CAST(20 AS DOUBLE) AS x1, (l_suppkey % 25) * CAST(16 AS DOUBLE) AS y1,
        (l_partkey % 40) * CAST(20 AS DOUBLE) + 40 + l_quantity * 4 AS x2, (l_suppkey % 25) * CAST(16 AS DOUBLE) + 20 + l_linenumber * 6 AS y2
        FROM lineitem""",
    "fx_pred": """SELECT l_orderkey AS image_id, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS pred_id,
        CASE WHEN j % 11 = 0 THEN 1 - l_linenumber % 2 ELSE l_linenumber % 2 END AS cls, CAST(0.05 AS DOUBLE) + (j % 941) / CAST(1000 AS DOUBLE) AS score,
        (l_partkey % 40) * CAST(20 AS DOUBLE) + (j % 13) - 6 AS x1, (l_suppkey % 25) * CAST(16 AS DOUBLE) + (j % 7) - 3 AS y1,
        (l_partkey % 40) * CAST(20 AS DOUBLE) + 40 + l_quantity * 4 + (j % 17) - 8 AS x2,
        (l_suppkey % 25) * CAST(16 AS DOUBLE) + 20 + l_linenumber * 6 + (j % 5) - 2 AS y2
        FROM (SELECT *, l_partkey * 31 + l_suppkey * 17 + l_linenumber * 7 AS j FROM lineitem) b WHERE j % 9 <> 0""",
    "fx_pairs": """SELECT pair_id, lang, writer_id, ref, CASE pair_id % 4 WHEN 0 THEN ref WHEN 1 THEN replace(ref, 'e', 'c')
        WHEN 2 THEN replace(ref, 'en ', ' ') ELSE replace(ref, 't', '') END AS hyp
        FROM (SELECT doc_id * 1048576 + line_no AS pair_id, lang, source AS writer_id, line AS ref FROM {LINES} l) r""",
    "fx_samples": """SELECT concat('s', event_id) AS sample_id, concat('w', user_id) AS writer_id, event_type AS cls,
        CASE WHEN event_id % 10 = 0 THEN '' ELSE concat('text ', event_id) END AS text FROM events""",
    "fx_slides": """SELECT concat(substr(md5(concat('', o_orderkey)), 1, 8), '-lecture_', o_custkey % 60, '_page-', lpad(concat('', o_orderkey), 6, '0')) AS stem FROM orders""",
    "fx_results": """SELECT user_id % 40 AS lecture, user_id AS slide, event_id AS region, CASE WHEN event_type IN ('click', 'view') THEN 'text' ELSE 'math' END AS type,
        event_type = 'purchase' OR event_type = 'error' AS rendered, value AS seconds FROM events""",
    "fx_log": """SELECT user_id % 40 AS lecture, event_id AS line_no,
        CASE event_type WHEN 'click' THEN concat('  Saved -> out/p', user_id, '.png (', event_id % 90, '.', event_id % 10, 's)')
        WHEN 'view' THEN concat('  Typeset filter dropped ', event_id % 7, ' region(s)') WHEN 'error' THEN 'Math OCR rejected garbage: x'
        WHEN 'purchase' THEN concat('  Post-OCR dedupe: dropped ', event_id % 3, ' near-duplicate text overlay(s)')
        ELSE 'Dropped text overlay covered by typeset math: y' END AS line FROM events""",
    "fx_scores": """SELECT o_orderkey AS item, s.sys AS system, (o_orderkey * (s.sys + 3) % 97) / CAST(97 AS DOUBLE) AS cer
        FROM orders CROSS JOIN (SELECT 0 AS sys UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) s""",
    "fx_points": """SELECT l_orderkey AS image_id, (l_partkey % 40) * CAST(20 AS DOUBLE) + (l_suppkey * 7 % 60) AS x,
        (l_suppkey % 25) * CAST(16 AS DOUBLE) + (l_partkey * 3 % 40) AS y FROM lineitem""",
    "fx_profile": """SELECT user_id AS region_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS row_no,
        CASE WHEN event_id % 500 < 300 THEN CAST(floor(value) AS INT) ELSE 0 END AS ink FROM events""",
    "fx_images": """SELECT DISTINCT l_orderkey AS image_id, 1000 + l_orderkey % 7 * 100 AS w, 600 + l_orderkey % 5 * 50 AS h FROM lineitem""",
}
# Whole texts of documents as lines of 20 words, numbered from 0: {LINES} for Spark and for DuckDB.
# Spark cuts a text in one pass: slices of an array of its words would each go through the whole array. Braces are doubled for the formatter of spark.sql.
_SPARK_LINES = """(SELECT doc_id, lang, source, posexplode(regexp_extract_all(replace(text, chr(10), ' '), '(?:^| )([^ ]*+(?: [^ ]*+){{0,19}}+)', 1)) AS (line_no, line)
        FROM documents d)"""
_DUCK_LINES = """(SELECT doc_id, lang, source, unnest(range((len(w) - 1) // 20 + 1)) AS line_no, unnest(list_transform(range((len(w) - 1) // 20 + 1), lambda n: array_to_string(w[n * 20 + 1 : n * 20 + 20], ' '))) AS line
        FROM (SELECT doc_id, lang, source, string_split(replace(text, chr(10), ' '), ' ') AS w FROM documents) d)"""
_LATEX_SQL = r"""SELECT p_partkey AS expr_id,
        CASE p_partkey % 5 WHEN 0 THEN concat('\frac{', p_size, '}{x_', p_partkey, '}') WHEN 1 THEN concat('\int f(x) \, dx = ', p_size)
        WHEN 2 THEN concat('\sum_{k=1}^{', p_size, '} k') WHEN 3 THEN concat('\begin{pmatrix} a \\ b \end{pmatrix} \cdot ', p_size)
        ELSE concat('x = ', p_size, ' \\ y = ', p_partkey) END AS gt,
        CASE p_partkey % 3 WHEN 0 THEN concat('$', p_name, ' = { x }$') WHEN 1 THEN repeat('\alpha ', 8) ELSE concat('\[ x_', p_size, ' \]') END AS pred
        FROM part"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table; fx_latex is built from columns, as what backslashes mean in SQL text is up to the session."""
    if name == "fx_latex":
        # One file of few bytes holds many expressions, and rules over them cost much more than the reading: rows are dealt out first.
        dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))
        p, size, key = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name").repartition(dealt), F.col("p_size"), F.col("p_partkey")
        t = F.lit
        gt = (
            F.when(key % 5 == 0, F.concat(t(r"\frac{"), size, t("}{x_"), key, t("}")))
            .when(key % 5 == 1, F.concat(t(r"\int f(x) \, dx = "), size))
            .when(key % 5 == 2, F.concat(t(r"\sum_{k=1}^{"), size, t("} k")))
            .when(key % 5 == 3, F.concat(t(r"\begin{pmatrix} a \\ b \end{pmatrix} \cdot "), size))
            .otherwise(F.concat(t("x = "), size, t(r" \\ y = "), key))
        )
        pred = F.when(key % 3 == 0, F.concat(t("$"), F.col("p_name"), t(" = { x }$"))).when(key % 3 == 1, t("\\alpha " * 8)).otherwise(F.concat(t(r"\[ x_"), size, t(r" \]")))
        return p.select(key.alias("expr_id"), gt.alias("gt"), pred.alias("pred"))
    sql = FIXTURES[name].replace("{G}", "").replace("{LINES}", _SPARK_LINES)
    used = [t for t in ("lineitem", "documents", "events", "orders") if re.search(rf"\b{t}\b", sql)]
    df = spark.sql(re.sub(rf"\b({'|'.join(used)})\b", r"{\1}", sql), **{t: table(spark, sf_dir, t) for t in used})
    # Scores take the square of a line's length, and long texts have many lines: lines are dealt out before they are scored.
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))) if name == "fx_pairs" else df


def oracle_text(sql: str) -> str:
    held = FIXTURES | {"fx_latex": _LATEX_SQL}
    used = [n for n in held if re.search(rf"\b{n}\b", sql)]
    ctes = [f"{n} AS ({held[n].replace('{G}', ", 'g'").replace('{LINES}', _DUCK_LINES)})" for n in used]
    body = re.sub(r"\b([a-z]) -> ", r"lambda \1: ", sql.strip())
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(ctes)}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(ctes)}, {body[5:]}"
    return f"WITH {', '.join(ctes)} {body}"


def query(sql: str | None = None) -> Callable:
    """Registers a query under the function's name, with DuckDB SQL for the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = oracle_text(sql)
        return f

    return add


#: Letters beyond ASCII of the given texts, and a control character for each: DuckDB's edit distance counts bytes, Spark's counts characters.
LETTERS = "äöüßÄÖÜéèêçñóíÉÈÊÇÑÓÍ"
_CODES = "concat(" + ", ".join(f"chr({c})" for c in [*range(1, 9), *range(14, 14 + len(LETTERS) - 8)]) + ")"


def edits(a: str, b: str) -> str:
    """SQL of the edit distance over characters."""
    return "levenshtein(" + ", ".join(f"translate({x}, '{LETTERS}', {_CODES})" for x in (a, b)) + ")"


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})
