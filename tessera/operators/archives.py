"""Office files and books as text, the hooks of plugins, and streams that write tables."""

from __future__ import annotations

import io
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.passages import PASSAGES_SQL, passages
from ..plans import hooks
from ..plans import views as V
from ..registry import ORACLES, example, query
from ..session import cut, shared_dir, table
from ..sources import office
from ..streaming.appends import BatchLog, continued
from ..streaming.sources import ingest, sliding_counts, watch_folder
from ..streaming.state import PROVIDER, Breaker, Ordered, RateLimit, keyed
from . import streams  # noqa: F401  (its oracles are those of the streams)
from .tables import Store


def packed(**members: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def given(spark: SparkSession, *files: tuple[str, bytes]) -> DataFrame:
    return spark.createDataFrame([(n, bytearray(b)) for n, b in files], "name string, content binary")


@example("sc06_epub", "SELECT * FROM (VALUES ('a.epub', 'First chapter' || chr(10) || 'It has a text that goes on for a while.' || chr(10) || chr(10) || 'Second chapter, short.'), ('b.epub', NULL), ('c.epub', NULL)) v(name, text)")
def sc06(spark, d):
    """SC06: chapters of a book in their order, without scripts and navigation; the expected texts are written out."""
    one = {"c1.xhtml": "<html><head><title>x</title></head><body><nav>menu</nav><h1>First chapter</h1><p>It has a text that goes on for a while.</p></body></html>", "c2.xhtml": "<p>Second chapter, short.</p><script>no()</script>", "c3.xhtml": "<p>tiny</p>"}
    read = F.udf(office.epub_text, "string", useArrow=True)
    return given(spark, ("a.epub", packed(**one)), ("b.epub", b"no archive"), ("c.epub", packed(**{"c.html": "<p>too short</p>"}))).select("name", read("content").alias("text"))


@example("sc07_docx", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), '## Scope'), (1, 'Plain text.'), (2, '| a | b |'), (3, '| 1 | 2 |')) v(row, line)")
def sc07(spark, d):
    """SC07: headings, paragraphs and table rows of a letter; the expected lines are written out."""
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, style="": f"<w:p>{style}<w:r><w:t>{t}</w:t></w:r></w:p>"
    row = lambda *c: "<w:tr>" + "".join(f"<w:tc>{p(x)}</w:tc>" for x in c) + "</w:tr>"
    heading = '<w:pPr><w:pStyle w:val="Heading2"/></w:pPr>'
    xml = f"<w:document {ns}><w:body>{p('Scope', heading)}{p('Plain text.')}{p('')}<w:tbl>{row('a', 'b')}{row('1', '2')}</w:tbl></w:body></w:document>"
    read = F.udf(office.docx_lines, "array<string>", useArrow=True)
    return given(spark, ("a.docx", packed(**{"word/document.xml": xml})), ("b.docx", b"")).select(F.posexplode(read("content")).alias("row", "line")).select(F.col("row").cast("long").alias("row"), "line")


@example("sc08_xlsx", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'part | size'), (1, 'A | 2.5'), (2, 'other')) v(row, line)")
def sc08(spark, d):
    """SC08: rows of all sheets, shared strings resolved, picture formulas dropped; the expected rows are written out."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = lambda *rows: f"<worksheet {ns}><sheetData>" + "".join(f"<row>{r}</row>" for r in rows) + "</sheetData></worksheet>"
    cell = lambda v, kind="": f"<c{kind}><v>{v}</v></c>"
    s = ' t="s"'
    files = {"xl/sharedStrings.xml": f"<sst {ns}><si><t>part</t></si><si><t>size</t></si><si><t>A</t></si></sst>", "xl/worksheets/sheet1.xml": sheet(cell(0, s) + cell(1, s), cell(2, s) + cell("2.5"), cell('=DISPIMG("x",1)')), "xl/worksheets/sheet10.xml": sheet(cell("other"))}
    read = F.udf(office.xlsx_rows, "array<string>", useArrow=True)
    return given(spark, ("a.xlsx", packed(**files))).select(F.posexplode(read("content")).alias("row", "line")).select(F.col("row").cast("long").alias("row"), "line")


@example("sc09_pptx", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'Title'), (1, 'Point one'), (2, 'Last slide')) v(row, line)")
def sc09(spark, d):
    """SC09: paragraphs of slides in their order; the expected ones are written out."""
    ns = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    slide = lambda *ps: f"<s {ns}>" + "".join(f"<a:p><a:r><a:t>{p}</a:t></a:r></a:p>" for p in ps) + "</s>"
    files = {"ppt/slides/slide10.xml": slide("Last slide"), "ppt/slides/slide2.xml": slide("Title", "", "Point one")}
    read = F.udf(office.pptx_paragraphs, "array<string>", useArrow=True)
    return given(spark, ("a.pptx", packed(**files))).select(F.posexplode(read("content")).alias("row", "line")).select(F.col("row").cast("long").alias("row"), "line")


@query("ud03_hooks", "SELECT id, '> ' || content AS content FROM chunks WHERE chunk_index = 0", "chunks")
def ud03(spark, d):
    """UD03: plugins' hooks on results: one replaces them, one fails and is passed over, one gives nothing and changes nothing."""

    def failing(df):
        raise ValueError("broken plugin")

    found = V.chunks(spark, d).filter("chunk_index = 0").select("id", "content")
    return hooks.run([failing, lambda df: df.withColumn("content", F.concat(F.lit("> "), "content")), lambda df: None], found)


# Manifests of plugins (literal rows): name, version, api version, kind, and whether the last word was to enable it.
MANIFESTS = (("notes", "1.0", "1", "tool", True), ("flows", "0.2", "1", "workflow", False), ("old", "1.0", "0", "tool", True), ("bad name", "1.0", "1", "tool", True), ("odd", "1", "1", "theme", True), ("notes", "1.1", "1", "tool", True))


@example("ud01_manifests", "SELECT * FROM (VALUES ('notes', '1.1', 'enabled'), ('flows', '0.2', 'disabled')) v(name, version, state)")
def ud01(spark, d):
    """UD01: valid manifests installed, the newer version in place of the older, then enabled or disabled."""
    m = spark.createDataFrame(list(MANIFESTS), "name string, version string, api string, kind string, on boolean")
    valid = m.filter(F.col("name").rlike("^[a-z][a-z0-9_-]*$") & (F.col("api") == "1") & F.col("kind").isin("tool", "workflow"))
    newest = valid.groupBy("name").agg(F.max_by(F.struct("version", "on"), "version").alias("v"))
    s = Store(spark)
    s.put("plugins", newest.select("name", "v.version", "v.on", F.lit("installed").alias("state")))
    return s.update("plugins", state=F.when(F.col("on"), "enabled").otherwise("disabled")).select("name", "version", "state")


@example("ud07_enabled_tools", "SELECT * FROM (VALUES ('notes')) v(name)")
def ud07(spark, d):
    """UD07: the tools that are enabled."""
    kinds = spark.createDataFrame([(m[0], m[3]) for m in MANIFESTS], "name string, kind string").distinct()
    return ud01(spark, d).filter("state = 'enabled'").join(kinds.filter("kind = 'tool'"), "name", "left_semi").select("name")


def streamed(spark: SparkSession, d: str, name: str, **options) -> DataFrame:
    reader = spark.readStream.schema(table(spark, d, name).schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.parquet(f"{d}/{name}.parquet*")


#: Characters of a page, and batches that the pages of the documents arrive in.
PAGE, ARRIVALS = 2000, 10
PAGED = f"paged AS (SELECT doc_id * {V.PLACES} + p AS doc_id, substring(text, CAST(p * {PAGE} + 1 AS BIGINT), {PAGE}) AS text FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / {PAGE}.0) AS BIGINT))) AS p FROM documents))"


def pages(docs: DataFrame) -> DataFrame:
    """doc_id, page, text: texts cut to pages."""
    at = F.when(F.length("text") > 0, F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PAGE).cast("int")))
    return docs.select("doc_id", "text", F.explode(at).alias("page")).select("doc_id", "page", F.substring("text", F.col("page") * PAGE + 1, F.lit(PAGE)).alias("text"))


def arrive(rows: DataFrame, slice_of: F.Column, slices: int, folder: str) -> None:
    """Writes ``rows`` one slice after the other, as they would arrive."""
    dealt = cut(rows.withColumn("_slice", slice_of))
    for i in range(slices):
        dealt.filter(F.col("_slice") == i).drop("_slice").coalesce(1).write.mode("append").parquet(folder)


def page_ingest(spark: SparkSession, log: BatchLog):
    """What a micro-batch of pages does: their passages, numbered on from where earlier batches left the file, and the new ends."""

    def write(batch: DataFrame, number: int) -> None:
        p = batch.select(F.col("doc_id").alias("file_id"), "page", F.posexplode(passages(F.col("text"))).alias("i", "p"))
        ends = log.read("ends", "file_id long, last long", before=number)
        rows = cut(continued(p.select("file_id", "page", "i", F.col("p.content").alias("content")), ends, "file_id", ["page", "i"], "chunk_index"))
        log.write(number, chunks=rows.select("file_id", "chunk_index", "content"), ends=rows.groupBy("file_id").agg(F.max("chunk_index").alias("last")))

    return write


CHUNK_ROWS = "file_id long, chunk_index long, content string"


@query("st07_stream_ingest", f"WITH {PAGED}, p AS ({PASSAGES_SQL.replace('FROM documents', 'FROM paged')}) SELECT doc_id // {V.PLACES} AS file_id, CAST(row_number() OVER (PARTITION BY doc_id // {V.PLACES} ORDER BY doc_id, chunk_index) - 1 AS BIGINT) AS chunk_index, md5(content) AS digest FROM p")
def st07(spark, d):
    """ST07, SC13: pages of documents arrive in ten batches and are cut and appended; the fifth comes again, as after a
    failure, and takes the place of what it wrote before."""
    root = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}/ingest-{uuid.uuid4().hex}"
    log = BatchLog(spark, f"{root}/tables")
    arrive(pages(V.documents(spark, d)), F.least(F.col("page"), F.lit(ARRIVALS - 1)), ARRIVALS, f"{root}/in")
    write = page_ingest(spark, log)

    def store(batch: DataFrame, number: int) -> None:
        for _ in range(2 if number == 4 else 1):
            write(batch, number)

    stream = spark.readStream.schema("doc_id long, page int, text string").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    ingest(stream, store, f"{root}/checkpoint").awaitTermination()
    return log.read("chunks", CHUNK_ROWS).select("file_id", "chunk_index", F.md5("content").alias("digest"))


@query("st01_stream_windows", "SELECT w AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('hour', ts) - INTERVAL 2 HOUR, date_trunc('hour', ts) - INTERVAL 1 HOUR, date_trunc('hour', ts)]) AS w FROM events) GROUP BY ALL")
def st01(spark, d):
    """ST01 as a stream: sliding windows with a watermark; each batch appends the windows that it changed, the last form counts."""
    root = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}/windows-{uuid.uuid4().hex}"
    log = BatchLog(spark, f"{root}/tables")
    events = streamed(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = sliding_counts(events, "3 hours", "1 hour").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
    store = lambda batch, number: log.write(number, w=batch)
    counts.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return log.latest("w", "start timestamp_ntz, event_type string, n long", ["start", "event_type"])


def keyed_events(spark: SparkSession, d: str, rule: Ordered, kind: str, key: str = "user_id", slices: int = 3) -> DataFrame:
    """A rule over the events as they arrive, in slices of time; an event of another key long after the last one tells the
    watermark that the table is over."""
    root = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}/keyed-{uuid.uuid4().hex}"
    log = BatchLog(spark, f"{root}/tables")
    events = table(spark, d, "events").select(key, "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"))
    span = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    lo, hi = (F.unix_micros(F.lit(span[c])) for c in ("lo", "hi"))
    arrive(events, F.floor((F.unix_micros("ts") - lo) * slices / (hi - lo + 1)).cast("int"), slices, f"{root}/in")
    end = spark.range(1).select(F.lit(-1).cast("long").alias(key), F.lit(-1).cast("long").alias("event_id"), (F.lit(span["hi"]) + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(True).alias("ok"))
    end.coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    told = keyed(stream, key, rule, kind, "1 hour")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        store = lambda batch, number: log.write(number, told=batch)
        told.writeStream.outputMode("append").foreachBatch(store).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return log.read("told", f"event_id long, {rule.value} {kind}").drop("batch")


@query("st02_stream_rate_limit", ORACLES["st02_rate_limit"])
def st02_stream(spark, d):
    """ST02 as a stream: 5 calls a user in 36 hours, by keyed state."""
    return keyed_events(spark, d, RateLimit(5, 36 * 3600 * 1_000_000), "boolean")


@query("st03_stream_breaker", ORACLES["st03_circuit_breaker"])
def st03_stream(spark, d):
    """ST03 as a stream: a breaker for each user, by keyed state."""
    return keyed_events(spark, d, Breaker(2, 86_400_000_000), "string")


@example("sc19_watched_folder", "SELECT CAST(2 AS BIGINT) AS seen, CAST(0 AS BIGINT) AS seen_again")
def sc19(spark, d):
    """SC19: a folder watched twice, with a file more the second time: each file is seen once."""
    s = Store(spark)
    s.put("seen", spark.createDataFrame([], "path string, content_hash string"))
    for word in ("first", "second"):
        spark.createDataFrame([(word,)], "value string").coalesce(1).write.mode("append").text(f"{s.root}/in")
        note = lambda batch, number: s.append("seen", batch.select("path", "content_hash")) and None
        ingest(watch_folder(spark, f"{s.root}/in"), note, f"{s.root}/watch").awaitTermination()
    n = s.get("seen").groupBy("path").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("seen"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("seen_again"))
