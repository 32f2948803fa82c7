"""Queries of sources and sinks: they write files from the given tables to a scratch folder with Spark and read them back."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import boxes
from folioscope.functions.ranks import global_rank
from folioscope.operators import sampling
from folioscope.plans.registry import fixture, query, rounded, table
from folioscope.sources import ranges, readers, writers
from folioscope.sources.scratch import scratch


def written(df: DataFrame, label: str, files: int = 4) -> str:
    """Rows of one text column as files of lines."""
    path = scratch(df.sparkSession, label)
    df.repartition(files).write.text(path)
    return path


@query("SELECT sample_id AS image, CASE WHEN text <> '' THEN text ELSE concat('alt ', sample_id) END AS truth, writer_id FROM fx_samples")
def read_manifest(spark, d):
    s = fixture(spark, d, "fx_samples")
    one = F.struct(F.col("sample_id").alias("image"), F.lit("").alias("gt_latex"), F.when(F.col("text") == "", F.concat(F.lit("alt "), F.col("sample_id"))).alias("latex"), "text", "writer_id")
    number = F.floor(F.substring("sample_id", 2, 18).cast("long") / 16384)  # files grow in number, not in size, whatever the number of writers
    grouped = s.groupBy(number.alias("n")).agg(F.collect_list(one).alias("samples"))
    value = F.when(F.col("n") % 2 == 0, F.to_json("samples")).otherwise(F.to_json(F.struct("samples")))
    path = scratch(spark, "manifest")
    grouped.select(value.alias("value"), "n").write.partitionBy("n").text(path)
    return readers.read_manifest(spark, f"{path}/*").select("image", "truth", "writer_id")


@query("SELECT image_id, concat(image_id, '.png') AS file_name, cls AS category_id, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h FROM fx_gt")
def read_coco(spark, d):
    gt = fixture(spark, d, "fx_gt")
    ann = F.struct(F.crc32("gt_id").alias("id"), "image_id", F.col("cls").alias("category_id"), F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("bbox"))
    part = gt.groupBy(F.floor(F.col("image_id") / 4096).alias("n")).agg(F.collect_list(ann).alias("annotations"))
    images = F.transform(F.array_distinct("annotations.image_id"), lambda i: F.struct(i.alias("id"), F.concat(i, F.lit(".png")).alias("file_name")))
    path = scratch(spark, "coco")
    part.select("n", F.to_json(F.struct(images.alias("images"), "annotations")).alias("value")).write.partitionBy("n").text(path)
    images, anns, _ = readers.read_coco(spark, f"{path}/*", 1 << 18)  # small files whole, others in parts
    return anns.join(images.select("image_id", "file_name"), "image_id").select("image_id", "file_name", "category_id", "x", "y", "w", "h")


_LABELS = """SELECT image_id, gt_id, cls, greatest(0, least((x1 + (x2 - x1) / 2) / 1000, 1)) AS cx, greatest(0, least((y1 + (y2 - y1) / 2) / 600, 1)) AS cy, greatest(0, least((x2 - x1) / 1000, 1)) AS bw,
  greatest(0, least((y2 - y1) / 600, 1)) AS bh FROM fx_gt"""


@query(f"SELECT CAST(cls AS VARCHAR) AS cls, {', '.join(f"CAST(printf('%.6f', {c}) AS DOUBLE) AS {c}" for c in ('cx', 'cy', 'bw', 'bh'))} FROM ({_LABELS}) q WHERE bw >= 0.001 AND bh >= 0.001")
def read_yolo_labels(spark, d):
    return rounded(readers.read_yolo_labels(spark, written(_label_lines(spark, d), "yolo")).select("cls", "cx", "cy", "bw", "bh"), "cx", "cy", "bw", "bh")


def _yolo(spark, d):
    gt = fixture(spark, d, "fx_gt").withColumns({"x": F.col("x1"), "y": F.col("y1"), "w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1"), "img_w": F.lit(1000), "img_h": F.lit(600)})
    return boxes.coco_to_yolo(gt)


def _label_lines(spark, d):
    text = writers.yolo_label_text(_yolo(spark, d), order="gt_id")
    return text.select(F.explode(F.split(F.concat("text", F.lit("\n\nmath 1 1 1 1\n0 0.5")), "\n")).alias("value"))


@query(f"SELECT image_id, string_agg(printf('%s %.6f %.6f %.6f %.6f', CAST(cls AS VARCHAR), cx, cy, bw, bh), chr(10) ORDER BY gt_id) AS text FROM ({_LABELS}) q WHERE bw >= 0.001 AND bh >= 0.001 GROUP BY image_id")
def write_yolo_labels(spark, d):
    path = scratch(spark, "labels")
    writers.write_yolo_labels(_yolo(spark, d), path, order="gt_id")
    return spark.read.parquet(path)


@query("SELECT CAST(c_custkey + 10000 AS VARCHAR) AS writer_id, CASE WHEN c_custkey % 3 = 0 THEN 'German' ELSE 'Swiss German' END AS language FROM customer WHERE c_custkey % 3 <> 2")
def read_writers_xml(spark, d):
    c = table(spark, d, "customer")
    lang = F.when(F.col("c_custkey") % 3 == 0, "German").when(F.col("c_custkey") % 3 == 1, "Swiss German").otherwise("French")
    one = F.concat(F.lit('<Writer name="'), F.col("c_custkey") + 10000, F.lit('" NativeLanguage="'), lang, F.lit('"/>'))
    path = scratch(spark, "writers")
    c.groupBy(F.floor(F.col("c_custkey") / 1000).alias("n")).agg(F.concat(F.lit("<Writers>\n"), F.array_join(F.collect_list(one), "\n"), F.lit("\n</Writers>")).alias("value")).write.partitionBy("n").text(path)
    return readers.read_writers_xml(spark, path)


def _archives(spark, d) -> str:
    """Form files of customers in archives of 200, files that tasks write: compressed tars, zips and plain tars in turn."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    body = F.when(k % 11 == 0, F.concat(F.lit('<form id="f'), k, F.lit('" writer-id="'), k)).otherwise(F.concat(F.lit('<?xml version="1.0"?>\n<form id="f'), k, F.lit('" writer-id="'), k, F.lit('"><line/></form>')))
    files = c.groupBy(F.floor(k / 200).alias("n")).agg(F.collect_list(F.struct(F.concat(F.lit("xml/f"), k, F.lit(".xml")).alias("name"), body.alias("body"))).alias("files"))
    folder = scratch(spark, "archives")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, members in zip(b.column("n").to_pylist(), b.column("files").to_pylist()):
                buffer, kind = io.BytesIO(), ("tgz", "zip", "tar")[n % 3]
                if kind == "zip":
                    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                        for m in members:
                            z.writestr(m["name"], m["body"])
                else:
                    with tarfile.open(fileobj=buffer, mode="w:gz" if kind == "tgz" else "w") as t:
                        for m in members:
                            info = tarfile.TarInfo(m["name"])
                            info.size = len(m["body"].encode())
                            t.addfile(info, io.BytesIO(m["body"].encode()))
                ranges.write_file(f"{folder}/forms-{n}.{kind}", buffer.getvalue())
            yield pa.RecordBatch.from_arrays([b.column("n")], ["n"])

    files.mapInArrow(pack, "n long").write.format("noop").mode("overwrite").save()
    return folder


_HALF = "concat('<form id=\"f', c_custkey, '\" writer-id=\"', c_custkey)"
_SIZES = f"""SELECT concat('xml/f', c_custkey, '.xml') AS member, CASE WHEN c_custkey % 11 = 0 THEN length({_HALF}) ELSE length(concat('<?xml version="1.0"?>', chr(10), {_HALF}, '"><line/></form>')) END AS size FROM customer"""


@query(_SIZES)
def read_archive_members(spark, d):
    return readers.read_archive_members(spark, _archives(spark, d), ".xml").select("member", F.length("content").alias("size"))


@query(f"{_SIZES} WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def read_wanted_members(spark, d):
    """The forms of customers with orders: their names are known, so no other member is read."""
    keys = table(spark, d, "orders").select(F.concat(F.lit("f"), "o_custkey").alias("key"))
    form = lambda member: F.regexp_extract(member, r"([^/]+)\.xml$", 1)
    return readers.read_archive_members(spark, _archives(spark, d), ".xml", keys, form).select("member", F.length("content").alias("size"))


@query("SELECT concat('f', c_custkey) AS form, CAST(c_custkey + 10000 AS VARCHAR) AS writer_id FROM customer WHERE c_custkey % 11 <> 0")
def read_form_writer_map(spark, d):
    return readers.read_form_writer_map(spark, _archives(spark, d))


@query("SELECT concat('a01-', o_orderkey) AS line_id, concat('total ', o_custkey, ' end') AS text FROM orders WHERE o_orderkey % 10 <> 0")
def read_ascii_lines(spark, d):
    o = table(spark, d, "orders")
    full = F.concat(F.lit("a01-"), F.col("o_orderkey"), F.lit(" ok 154 19 408 746 1661 89 total|"), F.col("o_custkey"), F.lit("|end"))
    line = F.when(F.col("o_orderkey") % 20 == 0, F.lit("# note")).when(F.col("o_orderkey") % 10 == 0, F.lit("short line")).otherwise(full)
    return readers.read_ascii_lines(spark, written(o.select(line.alias("value")), "ascii"))


def inks(spark, d) -> DataFrame:
    """ink_id, xml of one ink an event user: annotations and traces."""
    e = table(spark, d, "events").select("user_id", "event_id", F.round("value", 2).alias("v"))
    trace = F.concat(F.lit("<trace>"), F.col("event_id") % 300, F.lit(" "), F.col("event_id") % 200, F.lit(", "), F.col("event_id") % 310, F.lit(" x, "), F.col("event_id") % 290, F.lit(" "), F.col("event_id") % 190, F.lit("</trace>"))
    by = e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", trace.alias("t")))), lambda x: x["t"]), "\n").alias("ts"))
    note = F.when(F.col("user_id") % 4 == 0, F.lit('<annotation type="other">no</annotation>')).when(F.col("user_id") % 4 == 1, F.concat(F.lit('<annotation type="writer">w</annotation><annotation type="truth"> x_'), F.col("user_id"), F.lit(" </annotation>"))).otherwise(
        F.concat(F.lit('<annotation type="mytruth">y_'), F.col("user_id"), F.lit("</annotation>"))
    )
    return by.select(F.col("user_id").alias("ink_id"), F.concat(F.lit('<ink xmlns="http://www.w3.org/2003/InkML">'), note, "ts", F.lit("</ink>")).alias("xml"))


@query("SELECT ink_id, CASE WHEN ink_id % 4 = 1 THEN concat('x_', ink_id) ELSE concat('y_', ink_id) END AS truth FROM (SELECT DISTINCT user_id AS ink_id FROM events) q WHERE ink_id % 4 <> 0")
def read_inkml_truth(spark, d):
    return inks(spark, d).select("ink_id", readers.inkml_truth(F.col("xml")).alias("truth")).where("truth IS NOT NULL")


@query("""WITH p AS (SELECT user_id AS ink_id, CAST(event_id % 300 AS DOUBLE) AS x, CAST(event_id % 200 AS DOUBLE) AS y FROM events UNION ALL SELECT user_id, CAST(event_id % 290 AS DOUBLE), CAST(event_id % 190 AS DOUBLE) FROM events),
  b AS (SELECT ink_id, min(x) AS x0, min(y) AS y0 FROM p GROUP BY ink_id) SELECT p.ink_id, x - x0 + 20 AS x, y - y0 + 20 AS y FROM p JOIN b ON p.ink_id = b.ink_id""")
def ink_points(spark, d):
    traces = F.xpath("xml", F.lit("//*[local-name()='trace']/text()"))
    rows = inks(spark, d).select("ink_id", F.posexplode(traces).alias("stroke_no", "trace"))
    return readers.ink_points(rows)[0].select("ink_id", "x", "y")


@query("SELECT CAST(lecture AS VARCHAR) AS lecture, concat('p', slide, '.png') AS slide, type, rendered FROM fx_results")
def read_run_results(spark, d):
    """One file for the slides of a lecture below each 2,000th slide number."""
    r = fixture(spark, d, "fx_results")
    regions = r.groupBy("lecture", "slide").agg(F.collect_list(F.struct("type", "rendered", F.col("seconds").alias("confidence"))).alias("rs"))
    value = F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("p"), F.col("slide"), F.lit(".png")), F.col("rs")))))
    path = scratch(spark, "runs")
    parts = regions.groupBy("lecture", F.floor(F.col("slide") / 2000).alias("n")).agg(value.alias("value"))
    parts.write.partitionBy("n", "lecture").text(path)
    out = readers.read_run_results(spark, f"{path}/*/*/*.txt", 1 << 12)
    return out.select(F.regexp_replace("lecture", "^lecture=", "").alias("lecture"), "slide", "type", "rendered")


@query("""SELECT CAST(system AS VARCHAR) AS backend, track, concat('img', item) AS image, round(CASE WHEN track = 'raw' THEN cer ELSE cer * CAST(0.5 AS DOUBLE) END, 6) AS cer
  FROM fx_scores CROSS JOIN (SELECT 'raw' AS track UNION ALL SELECT 'post') t""")
def flatten_eval_report(spark, d):
    """One report for each 2,048 items."""
    s = fixture(spark, d, "fx_scores").withColumn("n", F.floor(F.col("item") / 2048))
    track = lambda k: F.struct(F.lit(0.0).alias("exp_rate"), (F.col("cer") * k).alias("cer"), F.lit(0.5).alias("bleu"), F.lit(1.0).alias("edit"))
    sample = F.struct(F.concat(F.lit("img"), F.col("item")).alias("image"), F.array(F.lit("short")).alias("tags"), track(1.0).alias("raw"), track(0.5).alias("post"))
    per = s.groupBy("n", "system").agg(F.struct(F.collect_list(sample).alias("per_sample")).alias("b"))
    reports = per.groupBy("n").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(F.col("system").cast("string"), "b"))).alias("backends"))).alias("value"))
    return rounded(readers.flatten_eval_report(reports).select("backend", "track", "image", "cer"), "cer")


@query("SELECT concat('m', p_partkey) AS model, 1536 AS imgsz, 100 AS epochs, (p_partkey % 97) / CAST(100 AS DOUBLE) AS \"mAP50\" FROM part")
def read_training_summary(spark, d):
    p = table(spark, d, "part")
    rec = F.to_json(F.struct(F.concat(F.lit("m"), F.col("p_partkey")).alias("model"), F.lit(1536).alias("imgsz"), F.lit(100).alias("epochs"), (F.col("p_partkey") % 97 / 100).alias("mAP50")))
    path = scratch(spark, "summaries")
    p.select(F.floor(F.col("p_partkey") / 500).alias("n"), rec.alias("r")).groupBy("n").agg(F.concat(F.lit("["), F.array_join(F.collect_list("r"), ","), F.lit("]")).alias("value")).write.partitionBy("n").text(path)
    return readers.read_training_summary(spark, f"{path}/*").select("model", "imgsz", "epochs", "mAP50")


@query("SELECT concat('img', p_partkey) AS name, concat('a b ', p_size) AS tokens FROM part WHERE p_partkey % 9 <> 0")
def read_captions(spark, d):
    p = table(spark, d, "part")
    rows = p.where("p_partkey % 9 <> 0").select(F.concat(F.lit("img"), F.col("p_partkey")).alias("name"), F.array(F.lit("a"), F.lit("b"), F.col("p_size").cast("string")).alias("tokens"))
    blank = p.where("p_partkey % 9 = 0").select(F.lit("  ").alias("value"))
    path = written(rows.select(writers.caption_line().alias("value")).union(blank), "captions")
    return readers.read_captions(spark, path).select("name", F.array_join("tokens", " ").alias("tokens"))


@query("SELECT concat('img', p_partkey, ' a b ', p_size) AS value FROM part")
def write_captions(spark, d):
    p = table(spark, d, "part")
    path = scratch(spark, "captions")
    writers.write_captions(p.select(F.concat(F.lit("img"), F.col("p_partkey")).alias("name"), F.array(F.lit("a"), F.lit("b"), F.col("p_size").cast("string")).alias("tokens")), path)
    return spark.read.text(path)


@query("SELECT user_id AS writer, count(*) AS n FROM events GROUP BY user_id")
def detect_column(spark, d):
    e = table(spark, d, "events")
    found = readers.detect_column(e, readers.WRITER_COLUMNS)
    return e.groupBy(F.col(found).alias("writer")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT concat('img', expr_id) AS name, gt AS latex FROM fx_latex WHERE expr_id % 10 <> 7")
def write_tsv_labels(spark, d):
    x = fixture(spark, d, "fx_latex").select(F.concat(F.lit("img"), F.col("expr_id")).alias("name"), F.col("gt").alias("latex"))
    path = scratch(spark, "tsv")
    writers.write_tsv_labels(x, x.where("name NOT LIKE '%7'").select("name"), path)
    return spark.read.option("quote", "").csv(path, sep="\t", schema="name string, latex string")


@query("""SELECT printf('A%03d', k) AS id, lecture, CAST(slide AS VARCHAR) AS page, region, concat_ws(';', lecture, slide % 100, lecture + 50, slide % 100 + 20) AS bbox, printf('%.3f', conf) AS confidence FROM (
  SELECT *, row_number() OVER (ORDER BY lecture, slide, region) AS k, (region % 1000) / CAST(1000 AS DOUBLE) AS conf FROM fx_results WHERE type = 'math') q""")
def write_audit_csv(spark, d):
    r = fixture(spark, d, "fx_results").where("type = 'math'")
    ranked = global_rank(r, F.col("lecture"), ["lecture", "slide", "region"], "rank")
    rows = ranked.select("rank", "lecture", F.col("slide").cast("string").alias("page"), "region", F.col("lecture").alias("x1"), (F.col("slide") % 100).alias("y1"), (F.col("lecture") + 50).alias("x2"), (F.col("slide") % 100 + 20).alias("y2"), ((F.col("region") % 1000) / F.lit(1000.0)).alias("confidence"), F.lit("x").alias("latex"))
    path = scratch(spark, "audit")
    writers.write_audit_csv(rows, path)
    back = spark.read.csv(path, header=True, schema="id string, lecture long, page string, region long, bbox string, confidence string, latex string, verdict string, notes string")
    return back.select("id", "lecture", "page", "region", "bbox", "confidence")


@query("""SELECT split, CAST(CASE split WHEN 'train' THEN floor(n * CAST(0.7 AS DOUBLE)) WHEN 'val' THEN floor(n * CAST(0.15 AS DOUBLE)) ELSE 0 END AS BIGINT) AS n_samples
  FROM (SELECT count(*) AS n FROM fx_samples) q CROSS JOIN (SELECT unnest(['train', 'val', 'test']) AS split) s""")
def write_split_manifests(spark, d):
    s = sampling.three_way_split(fixture(spark, d, "fx_samples"), "sample_id").where("split <> 'test'")
    return writers.write_split_manifests(s, scratch(spark, "splits"), ["train", "val", "test"])


@query("""SELECT 'samples' AS name, 'text,math' AS classes, 'events' AS source, '2026-01-01' AS date, CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) AS n_train, CAST(floor(n * CAST(0.15 AS DOUBLE)) AS BIGINT) AS n_val,
  CAST(n - floor(n * CAST(0.7 AS DOUBLE)) - floor(n * CAST(0.15 AS DOUBLE)) AS BIGINT) AS n_test, n AS n_total FROM (SELECT count(*) AS n FROM fx_samples) q""")
def dataset_info(spark, d):
    s = sampling.three_way_split(fixture(spark, d, "fx_samples"), "sample_id")
    return writers.dataset_info(s, "samples", "events", "2026-01-01", ["train", "val", "test"], ["text", "math"])


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey FROM supplier")
def list_images(spark, d):
    """A file a supplier, of which the keys are listed from the paths; tasks write the files, 1,000 keys to a folder."""
    path = scratch(spark, "images")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column("s_suppkey").to_pylist():
                ranges.write_file(f"{path}/{k // 1000}/s_suppkey={k}.txt", b"x\n")
            yield b

    ranges.dealt(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey").mapInArrow(write, "s_suppkey long").write.format("noop").mode("overwrite").save()
    return readers.list_images(spark, path, ("txt",)).select(F.regexp_extract("path", r"/s_suppkey=(\d+)\.txt$", 1).alias("s_suppkey"))


@query("""SELECT s.split, count(q.split) AS n_images, count(q.split) > 0 AS ok FROM (SELECT unnest(['click', 'view', 'none']) AS split) s
  LEFT JOIN (SELECT cls AS split FROM fx_samples WHERE CAST(substr(sample_id, 2) AS INT) % 3 <> 0) q ON s.split = q.split GROUP BY s.split""")
def validate_splits(spark, d):
    n = F.substring("sample_id", 2, 12).cast("int")
    files = fixture(spark, d, "fx_samples").select(F.col("cls").alias("split"), F.concat("sample_id", F.when(n % 3 == 0, ".txt").when(n % 3 == 1, ".PNG").otherwise(".jpg")).alias("path"))
    return readers.validate_splits(files, spark.createDataFrame([("click",), ("view",), ("none",)], "split string"))
