"""Sources and sinks of statement tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ACCOUNT_SCHEMAS = {
    "users": "id string, name string, mobile string, role string, is_super_admin boolean, is_admin boolean, pages_used long, page_limit long, plan_name string, plan_expires_at timestamp_ntz, created_at timestamp_ntz",
    "statements": "id string, user_id string, filename string, bank string, status string, row_count long, page_count long, owner_name string, owner_mobile string, owner_deleted boolean, issue struct<number string, title string, note string, status string, created_at timestamp_ntz>, created_at timestamp_ntz",
    "messages": "id string, source string, phone string, status string, salesperson_id string, created_at timestamp_ntz",
    "payments": "order_id string, user_id string, plan string, pages long, base_paise long, gst_paise long, amount long, status string, created_at timestamp_ntz",
}
WEBHOOK = "event string, payload struct<payment struct<entity struct<id string, order_id string, amount long, error_description string>>, order struct<entity struct<id string, amount_paid long>>>, _corrupt string"


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; a local one only for a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{found.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to a new shared folder and read from there, for rows that several jobs read."""
    path = f"{scratch_folder(df.sparkSession)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_cell_csv(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, cells) of row CSV files: all columns text, missing cells ""."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = raw.columns
    return raw.select(F.col("_metadata.file_name").alias("file_name"), F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in names]).alias("cells"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_records_json(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """JSON lines, characters as they are."""
    out = df.write.mode("overwrite")
    (out.partitionBy(partition_by) if partition_by else out).json(path)


def write_info_rows(rows: DataFrame, path: str) -> None:
    rows.filter("label = 'info'").write.mode("overwrite").json(path)


def statement_documents(records: DataFrame, meta: DataFrame) -> DataFrame:
    """One nested document per statement of ``meta``: headers, data, row_count and meta's own columns."""
    one = records.groupBy("statement_id").agg(F.first("headers").alias("headers"), F.sort_array(F.collect_list(F.struct("seq", F.map_entries("rec").alias("e")))).alias("d"))
    data = F.transform(F.coalesce("d", F.array().cast("array<struct<seq:int,e:array<struct<key:string,value:string>>>>")), lambda x: F.map_from_entries(x["e"]))
    out = meta.join(one, "statement_id", "left").withColumn("data", data)
    return out.withColumn("row_count", F.size("data").cast("long")).withColumn("status", F.when(F.col("row_count") > 0, "success").otherwise("failed")).drop("d")


def read_accounts(spark: SparkSession, folder: str, name: str, kind: str = "parquet") -> DataFrame:
    """One of the account tables under its declared schema; fields that old rows lack are null."""
    return spark.read.schema(ACCOUNT_SCHEMAS[name]).format(kind).load(f"{folder}/{name}")


def parse_webhook_events(df: DataFrame, body: str = "body") -> DataFrame:
    """``df`` with kind, order_id, payment_id, amount, failure and rejected (malformed JSON)."""
    e = F.from_json(F.col(body), WEBHOOK, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    t = df.withColumn("_e", e)
    pay, order = "_e.payload.payment.entity", "_e.payload.order.entity"
    return t.select(
        *df.columns,
        F.col("_e.event").alias("kind"),
        F.coalesce(f"{pay}.order_id", f"{order}.id").alias("order_id"),
        F.col(f"{pay}.id").alias("payment_id"),
        F.coalesce(f"{pay}.amount", f"{order}.amount_paid").alias("amount"),
        F.nullif(F.col(f"{pay}.error_description"), F.lit("")).alias("failure"),
        F.coalesce(F.col("_e").isNull() | F.col("_e._corrupt").isNotNull(), F.lit(True)).alias("rejected"),
    )


def union_tables(*tables: DataFrame) -> DataFrame:
    """All tables of array cells as one, without rows of no cells."""
    return reduce(DataFrame.unionByName, tables).filter(F.size("cells") > 0)


def normalise_contact(df: DataFrame) -> DataFrame:
    """Contact messages with trimmed fields and one phone column; rows with neither email nor phone go."""
    clean = lambda *c: F.coalesce(*[F.nullif(F.trim(F.col(x)), F.lit("")) for x in c if x in df.columns], F.lit(None).cast("string"))
    phone: Column = clean("phone", "mobile", "contact")
    out = df.select(*[c for c in df.columns if c not in ("phone", "mobile", "contact", "email", "source")], clean("email").alias("email"), phone.alias("phone"), F.coalesce(clean("source"), F.lit("contact")).alias("source"))
    return out.filter("email IS NOT NULL OR phone IS NOT NULL")
