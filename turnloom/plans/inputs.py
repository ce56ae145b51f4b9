"""Inputs of the knowledge base's operators, derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..operators.flush import LOG_HEADER
from ..operators.turns import conversation_turns
from ..shared import spread, task_files
from ..ship import ship

#: Narrow limits, so that windows and cuts have an effect on short conversations.
TURNS, CHARS, LEAST = 4, 1500, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_turns(table(spark, sf_dir, "conversations"))


def flush_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("source"), "event_id")


def day(i: str) -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), (F.col(i) % 30).cast("int"))


def daily_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of a day's conversations in order."""
    first = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    minute = F.col("conv_id") % 1440
    entry = F.format_string("### Session (%02d:%02d)\n\n%s\n\n", (minute / 60).cast("int"), (minute % 60).cast("int"), F.coalesce("text", F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct("conv_id", "turn", entry.alias("e"))))
    by_day = first.groupBy(day("conv_id").alias("log_date")).agg(F.array_join(F.transform(rows, lambda r: r["e"]), "").alias("body"))
    name = F.date_format("log_date", "yyyy-MM-dd")
    logs = by_day.select(F.concat(name, F.lit(".md")).alias("file"), "log_date", F.concat(F.format_string(LOG_HEADER, name), "body").alias("content"))
    return logs.withColumn("hash", content_hash("content"))


def manifest(logs: DataFrame) -> DataFrame:
    d = F.dayofmonth("log_date")
    stale = F.when(d % 7 == 1, "stale").otherwise(F.col("hash"))
    return logs.where(d % 5 != 0).select("file", stale.alias("hash"), F.date_add("log_date", 1).cast("timestamp").alias("compiled_at"), (d / 100).cast("decimal(18,6)").alias("cost_usd"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), "text")
    docs = docs.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n"))))  # one row
    key = lambda i: F.concat(F.element_at(F.array(F.lit("concepts"), F.lit("connections"), F.lit("qa")), (i % 3 + 1).cast("int")), F.lit("/d"), i.cast("string"))
    i, n = F.col("i"), F.col("n")
    log = F.concat(F.lit("daily/"), F.date_format(day("i"), "yyyy-MM-dd"))
    usual = key((i * 7) % F.expr("n div 2"))
    targets = F.array(
        usual,
        F.when((i % 4 == 0) & (i + 1 < n), key(i + 1)),
        F.when(i % 8 == 1, key(i - 1)),
        F.when(i % 11 == 0, F.concat(F.lit("concepts/missing-"), i.cast("string"))),
        F.when(i % 5 == 0, F.lit("index")),
        F.when(i % 13 == 0, key(i)),
        F.when(i % 17 == 0, usual),
        F.when(i % 3 == 0, log),
    )
    # every fourth article has the sections that a compiled one should have, more or less of each
    formed = i % 4 == 1
    points = F.concat(F.lit("## Key Points\n\n"), F.repeat(F.lit("- A point\n"), (F.expr("i div 4") % 5 + 2).cast("int")), F.lit("\n## Details\n\n"))
    more = F.when(i % 8 == 1, F.concat(F.lit("\n\nMore on D"), i.cast("string"), F.lit("."))).otherwise("")
    cited = F.when(i % 12 != 1, F.concat(F.lit("\n## Sources\n\n- [["), log, F.lit("]]: all of it\n"))).otherwise("")
    bullets = F.array_join(F.transform(F.filter(targets, lambda t: t.isNotNull()), lambda t: F.concat(F.lit("- [["), t, F.lit("]]\n"))), "")
    front = F.when(i % 4 != 3, F.concat(F.lit('---\ntitle: "D'), i.cast("string"), F.lit('"\nsources: ['), log, F.lit(".md]\n---\n\n"))).otherwise("")
    content = F.concat(front, F.when(formed, points).otherwise(""), F.coalesce("text", F.lit("")), F.when(formed, more).otherwise(""), F.lit("\n\n## Related Concepts\n\n"), bullets, F.when(formed, cited).otherwise(""))
    return docs.select(F.split(key(i), "/")[0].alias("kind"), F.concat(key(i), F.lit(".md")).alias("path"), key(i).alias("key"), content.alias("content"), F.filter(F.array(F.concat(log, F.lit(".md")), F.when(i % 6 == 0, F.concat(F.lit("daily/"), F.date_format(F.date_add(day("i"), 1), "yyyy-MM-dd"), F.lit(".md")))), lambda x: x.isNotNull()).alias("sources"), day("i").alias("updated"), "i")


def extra_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("index", "# Knowledge Base Index"), ("log", "")], "key string, content string")


def _put_files(root: str) -> Callable[[Iterator[Row]], None]:
    def put(rows: Iterator[Row]) -> None:
        fs, base = task_files(root)
        made = set()
        for path, text in rows:
            name = f"{base}/{path}"
            folder, last = name.rsplit("/", 1)
            if folder not in made:
                fs.create_dir(folder, recursive=True)
                made.add(folder)
            own = f"{folder}/.{last}.{uuid4().hex}"  # hidden until it is whole
            with fs.open_output_stream(own) as out:
                out.write(f"{text or ''}\n".encode())
            fs.move(own, name)

    return put


def named_files(rows: DataFrame, root: str, dealt: bool = False) -> None:
    """Writes rows (path, text) as a file each, by its path below root, a folder that all executors share; tasks write theirs
    side by side. One of the same name is replaced. dealt: rows are spread over the cores as they are, and not shuffled."""
    ship(rows.sparkSession)
    named = rows.select("path", "text").where("path is not null")
    (named if dealt else named.repartition(rows.sparkSession.sparkContext.defaultParallelism)).foreachPartition(_put_files(root))


def index_of(articles_: DataFrame) -> DataFrame:
    return articles_.select("key", F.concat(F.lit("Article "), F.col("i").cast("string")).alias("summary"), F.array_join("sources", ", ").alias("sources"), "updated")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model responses: kept, failed, both marks, empty, and the five-section layout."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 10 + F.col("turn")).alias("id"), "text")
    layout = F.concat(F.lit("**Context:** "), F.coalesce("text", F.lit("")), F.lit("\n\n**Key Exchanges:**\n- first "), F.length("text").cast("string"), F.lit("\n- second\n\n**Decisions Made:**\n- decided "), F.col("id").cast("string"), F.lit("\n\n**Lessons Learned:**\n\n**Action Items:**\n- do it"))
    k = F.col("id") % 5
    made = F.when(k == 0, "FLUSH_OK").when(k == 1, "FLUSH_ERROR: E: x").when(k == 2, F.concat("text", F.lit(" FLUSH_ERROR FLUSH_OK"))).when(k == 3, "").otherwise(layout)
    return c.select("id", made.alias("response"))
