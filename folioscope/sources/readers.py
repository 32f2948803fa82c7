"""Readers of annotation, manifest, result and log formats."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.sources import ranges
from folioscope.sources.scratch import stored

TRUTH_KEYS = ("gt_latex", "latex", "text")
_SAMPLE = "image string, gt_latex string, latex string, text string, language string, writer_id string, line_id string"


def read_manifest(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """image, truth, language, writer_id, line_id, file of manifests that are a bare list or {"samples": [..]}; truth is the first key that isn't empty, else ''."""
    raw = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    bare = F.from_json("value", f"array<struct<{_typed(_SAMPLE)}>>")
    wrapped = F.from_json("value", f"struct<samples:array<struct<{_typed(_SAMPLE)}>>>")["samples"]
    rows = raw.select("file", F.explode(F.when(F.ltrim("value").startswith("["), bare).otherwise(wrapped)).alias("s"))
    truth = F.coalesce(*(F.nullif(F.col(f"s.{k}"), F.lit("")) for k in TRUTH_KEYS), F.lit(""))
    return rows.select("s.image", truth.alias("truth"), "s.language", "s.writer_id", "s.line_id", "file")


def _typed(fields: str) -> str:
    return ", ".join(":".join(f.split()) for f in fields.split(", "))


_COCO = (
    "images array<struct<id:long,file_name:string,height:int,width:int>>, annotations array<struct<id:long,image_id:long,category_id:int,bbox:array<double>,"
    "area:double,iscrowd:int,text:string,verified:boolean>>, categories array<struct<id:int,name:string>>"
)


def _large_parts(spark: SparkSession, path: str | list[str], split: int, level: int) -> DataFrame | None:
    """Places of the parts of files above `split` bytes, for `ranges.json_texts`; None if there is none, or if they can't be read by range."""
    large = stored(ranges.listed(spark, path).where(F.col("length") > split), "large-files")
    if large.isEmpty():
        return None
    places = stored(ranges.json_places(large, level, split), "json-parts")
    return places if places.where("start < 0").isEmpty() else None


def read_coco(spark: SparkSession, path: str, split: int = ranges.CHUNK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories). Files above `split` bytes are read by many tasks, runs of elements of about so many bytes each."""
    raw = spark.read.schema(_COCO).option("multiLine", True).json(path)
    large, parts = _large_parts(spark, path, split, 2), []
    raw = raw if large is None else raw.where(F.col("_metadata.file_size") <= split)
    for f in raw.schema.fields:
        rows = raw.select(F.explode(f.name).alias("x"))
        if large is not None:
            rows = rows.union(ranges.json_texts(large.where(F.col("field") == f.name)).select(F.explode(F.from_json("value", f.dataType)).alias("x")))
        parts.append(rows.select("x.*"))
    images, anns, cats = parts
    box = {n: F.col("bbox")[i] for i, n in enumerate(("x", "y", "w", "h"))}
    return images.withColumnRenamed("id", "image_id"), anns.withColumns(box).drop("bbox"), cats.withColumnsRenamed({"id": "category_id"})


def read_yolo_labels(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """stem, cls, cx, cy, bw, bh of label lines; blank ones, short ones and class names instead of numbers are skipped."""
    raw = spark.read.text(path).select(F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("stem"), F.filter(F.split(F.trim("value"), r"\s+"), lambda p: p != "").alias("p"))
    raw = raw.where((F.size("p") >= 5) & ~F.col("p")[0].isin("text", "math"))
    return raw.select("stem", F.col("p")[0].alias("cls"), *(F.col("p")[i].try_cast("double").alias(n) for i, n in enumerate(("cx", "cy", "bw", "bh"), 1)))


def read_writers_xml(spark: SparkSession, path: str) -> DataFrame:
    """writer_id, language of writers whose native language contains German."""
    rows = spark.read.format("xml").option("rowTag", "Writer").schema("_name string, _NativeLanguage string").load(path)
    return rows.select(F.col("_name").alias("writer_id"), F.col("_NativeLanguage").alias("language")).where(F.col("language").contains("German"))


def _opened(data: bytes, suffix: str) -> Iterator[tuple[str, Callable[[], bytes]]]:
    try:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for m in t:
                if m.isfile() and m.name.endswith(suffix):
                    yield m.name, lambda: t.extractfile(m).read()  # noqa: B023  called before the next member
            return
    except tarfile.TarError:
        pass
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for n in z.namelist():
                if n.endswith(suffix):
                    yield n, lambda: z.read(n)  # noqa: B023
    except zipfile.BadZipFile:
        return


def unpacked(archives: DataFrame, suffix: str) -> DataFrame:
    """archive, member, content of the members with a suffix in tar and zip archives (path, content), an archive at a time.

    Archives that don't open, and those without any wanted member, give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                for name, get in _opened(content, suffix):
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name]), pa.array([get()], pa.binary())], ["archive", "member", "content"])

    return archives.mapInArrow(run, ranges.MEMBERS)


def read_archive_members(spark: SparkSession, paths: str | list[str], suffix: str, keys: DataFrame | None = None, key: Callable[[Column], Column] | None = None) -> DataFrame:
    """archive, member, content of the members with a suffix in tar and zip archives.

    keys (a column `key`): only members of which key(member), the name itself if not given, is there are read at all. Members of a zip or a plain tar
    are dealt out to tasks one by one, from the places that its directory or its headers give; a compressed tar is a stream, gone
    through by one task for the names and by one for the contents. Archives that don't open, and those without any wanted
    member, give no row.
    """
    places = ranges.archive_places(spark, paths, suffix)
    if keys is not None:
        own = places.withColumn("key", key(F.col("member")) if key else F.col("member"))
        places = own.where("kind <> 'whole'").join(keys.select("key"), "key", "left_semi").select(*places.columns).union(places.where("kind = 'whole'"))
    places = stored(places, "members")
    out = ranges.read_places(places)
    whole = places.where("kind = 'whole'").select(F.col("archive").alias("path"))
    if not whole.isEmpty():
        more = unpacked(spark.read.format("binaryFile").load(paths).select("path", "content").join(whole, "path", "left_semi"), suffix)
        if keys is not None:
            more = more.withColumn("key", key(F.col("member")) if key else F.col("member")).join(keys.select("key"), "key", "left_semi").select(*out.columns)
        out = out.union(more)
    return out


def forms_of(members: DataFrame) -> DataFrame:
    """form, writer_id (10000 + number) of XML members; unreadable ones and those lacking either attribute are skipped."""
    text = members.select(F.decode("content", "UTF-8").alias("x"))
    root = F.regexp_extract("x", r"(?s)<(?![?!])[^>]*>", 0)
    attribute = lambda n: F.regexp_extract(root, rf'(?s)\s{n}\s*=\s*"([^"]*)"', 1)
    rows = text.select(attribute("id").alias("form"), attribute("writer-id").alias("w"), root.alias("r"), "x")
    name = F.regexp_extract("r", r"<([^\s/>]+)", 1)
    closed = F.col("r").endswith("/>") | F.rtrim("x").endswith(F.concat(F.lit("</"), name, F.lit(">")))
    rows = rows.where((F.col("form") != "") & (F.col("w") != "") & closed)
    return rows.select("form", (F.col("w").try_cast("int") + 10000).cast("string").alias("writer_id")).where("writer_id IS NOT NULL")


def read_form_writer_map(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return forms_of(read_archive_members(spark, paths, ".xml"))


def read_ascii_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_id, text of lines with nine fields at least (split at single spaces); the last field, bars as spaces."""
    raw = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    raw = raw.select(F.split(F.trim("value"), " ").alias("p")).where(F.size("p") >= 9)
    return raw.select(F.col("p")[0].alias("line_id"), F.translate(F.element_at("p", -1), "|", " ").alias("text"))


def inkml_truth(xml):
    """Stripped text of the first annotation of type truth, label or latex; failing that of a type that contains truth."""
    first = F.xpath_string(xml, F.lit("(//*[local-name()='annotation'][@type='truth' or @type='label' or @type='latex'])[1]"))
    second = F.xpath_string(xml, F.lit("(//*[local-name()='annotation'][contains(@type, 'truth')])[1]"))
    strip = lambda c: F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))
    return F.coalesce(strip(first), strip(second))


def read_inkml_truth(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), inkml_truth(F.col("value")).alias("truth"))
    return raw.where("truth IS NOT NULL")


def ink_points(traces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ink_id, stroke_no, point_no, x, y of parsable pairs; bounds and canvas of each ink). traces: ink_id, stroke_no, trace."""
    points = traces.select("ink_id", "stroke_no", F.posexplode(F.split("trace", ",")).alias("point_no", "p"))
    points = points.withColumn("q", F.filter(F.split(F.trim("p"), r"\s+"), lambda v: v != "")).where(F.size("q") >= 2)
    points = points.select("ink_id", "stroke_no", "point_no", F.col("q")[0].try_cast("double").alias("x"), F.col("q")[1].try_cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    b = points.groupBy("ink_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    side = lambda lo, hi: F.greatest((F.col(hi) - F.col(lo)).cast("int") + 40, F.lit(64))
    bounds = b.withColumns({"canvas_w": side("x0", "x1"), "canvas_h": side("y0", "y1")})
    shifted = points.join(bounds.select("ink_id", "x0", "y0"), "ink_id").select("ink_id", "stroke_no", "point_no", (F.col("x") - F.col("x0") + 20).alias("x"), (F.col("y") - F.col("y0") + 20).alias("y"))
    return shifted, bounds


_REGION = "bbox:array<double>,class:string,confidence:double,type:string,text:string,latex:string,rendered:boolean,source:string,line_texts:array<string>"


def read_run_results(spark: SparkSession, path: str, split: int = ranges.CHUNK) -> DataFrame:
    """lecture (parent directory), slide, region (index) and the region's fields. Files above `split` bytes are read by many tasks, runs of slides each."""
    large, name = _large_parts(spark, path, split, 1), F.col("_metadata.file_path").alias("path")
    raw = spark.read.text(path, wholetext=True)
    raw = raw.select(name, "value") if large is None else raw.where(F.col("_metadata.file_size") <= split).select(name, "value").union(ranges.json_texts(large).select("path", "value"))
    raw = raw.select(F.element_at(F.split("path", "/"), -2).alias("lecture"), F.from_json("value", f"map<string,array<struct<{_REGION}>>>").alias("m"))
    slides = raw.select("lecture", F.explode("m").alias("slide", "rs"))
    return slides.select("lecture", "slide", F.posexplode("rs").alias("region", "r")).select("lecture", "slide", "region", "r.*")


def parse_log(lines: DataFrame, key: str = "lecture") -> DataFrame:
    """Per key: seconds of slides and four drop counters; two sum a captured number, two count lines."""
    number = lambda p: F.regexp_extract("line", p, 1).try_cast("long")
    seconds = F.regexp_extract("line", r"Saved -> .+?\(([\d.]+)s\)", 1).try_cast("double")
    df = lines.withColumns({"_s": seconds, "_t": number(r"Typeset filter dropped (\d+) region"), "_d": number(r"Post-OCR dedupe: dropped (\d+) near-duplicate")})
    s = F.col("_s")
    return df.groupBy(key).agg(
        F.coalesce(F.sum("_t"), F.lit(0)).alias("typeset_drops"), F.coalesce(F.sum("_d"), F.lit(0)).alias("dedupe_drops"),
        F.count_if(F.col("line").contains("Dropped text overlay covered by typeset math")).alias("covered_drops"),
        F.count_if(F.col("line").contains("Math OCR rejected garbage:")).alias("garbage_rejects"),
        F.count(s).alias("n_timed"), F.avg(s).alias("mean_s"), F.median(s).alias("median_s"), F.min(s).alias("min_s"), F.max(s).alias("max_s"), F.sum(s).alias("total_s"),
    )


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path)
    return parse_log(raw.select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("lecture"), F.col("value").alias("line")))


_SCORES = "exp_rate:double,cer:double,bleu:double,edit:double"


def flatten_eval_report(reports: DataFrame, col: str = "value") -> DataFrame:
    """backend, track, image, tags and the scores of each sample of report JSON."""
    sample = f"struct<image:string,tags:array<string>,raw:struct<{_SCORES}>,post:struct<{_SCORES}>>"
    m = F.from_json(col, f"struct<backends:map<string,struct<per_sample:array<{sample}>>>>")["backends"]
    rows = reports.select(F.explode(m).alias("backend", "b")).select("backend", F.explode("b.per_sample").alias("s"))
    track = F.explode(F.array(F.struct(F.lit("raw").alias("track"), F.col("s.raw").alias("v")), F.struct(F.lit("post").alias("track"), F.col("s.post").alias("v"))))
    return rows.select("backend", "s.image", "s.tags", track.alias("t")).where("t.v IS NOT NULL").select("backend", "t.track", "image", "tags", "t.v.*")


def read_training_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("model string, imgsz int, batch int, epochs int, save_dir string, best_weights string, mAP50 double, mAP50_95 double").option("multiLine", True).json(path)


def last_all_rows(lines: DataFrame, n: int, key: str = "run") -> DataFrame:
    """The last n lines of each run that start with `all` and have seven fields. lines: run, line_no, line."""
    rows = lines.withColumn("p", F.split(F.trim("line"), r"\s+")).where((F.col("p")[0] == "all") & (F.size("p") >= 7))
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("line_no")))).where(F.col("k") <= n).drop("k", "p")


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """name, tokens of caption lines; blank lines are skipped."""
    p = F.filter(F.split(F.trim("value"), r"\s+"), lambda t: t != "")
    return spark.read.text(path).where(F.trim("value") != "").select(p[0].alias("name"), F.slice(p, F.lit(2), F.size(p)).alias("tokens"))


TEXT_COLUMNS, WRITER_COLUMNS = ("text", "transcription", "label", "gt_text"), ("writer_id", "writer", "author", "user_id")


def detect_column(df: DataFrame, candidates: tuple[str, ...], required: bool = True) -> str | None:
    """The first candidate among the columns; if none, an error or None."""
    found = next((c for c in candidates if c in df.columns), None)
    if found is None and required:
        raise ValueError(f"none of {candidates} in {df.columns}")
    return found


def list_images(spark: SparkSession, path: str, exts: tuple[str, ...] = ("png", "jpg", "jpeg")) -> DataFrame:
    """Distinct paths below a folder with one of the extensions, whatever their case, without reading the files. Sub-folders are listed by tasks."""
    files = ranges.below(spark, path) if ranges.is_folder(path) else spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*exts)).distinct()


def validate_splits(files: DataFrame, required: DataFrame) -> DataFrame:
    """split, n_images (png and jpg), ok of every required split."""
    images = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin("png", "jpg")).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return required.join(images, "split", "left").select("split", F.coalesce("n", F.lit(0)).alias("n_images"), F.col("n").isNotNull().alias("ok"))
