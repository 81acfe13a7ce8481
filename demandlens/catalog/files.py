"""CSV folders that the queries write themselves from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandlens.catalog.base import SALES, query, rounded
from demandlens.session import shared_folder
from demandlens.sources import readers, schemas
from demandlens.sources.star import sales

# Two layouts of the same sales: another order of columns, one column less, one more.
FIRST = ["Transaction_ID", "Transaction_Date", "Category", "Region", "Units_Sold", "Discount_Applied", "Revenue"]
SECOND = ["Revenue", "Region", "Category", "Channel", "Units_Sold", "Transaction_Date", "Transaction_ID"]


def _transaction_folder(spark, sf) -> str:
    """Orders with an even key in the first layout, others in the second, faulty lines in both.

    A line of an order whose key divides by 97 lacks its last field, by 89 has a date that is none.
    """
    path = shared_folder(spark, "transactions-csv")
    df = sales(spark, sf, ["category", "region"])
    values = {
        "Transaction_ID": F.concat_ws("-", "l_orderkey", "l_linenumber"),
        "Transaction_Date": F.when(F.col("l_orderkey") % 89 == 0, "bad").otherwise(F.col("transaction_date").cast("string")),
        "Category": F.concat(F.lit('"'), F.col("category"), F.lit(', sold"')),
        "Region": F.col("region"),
        "Units_Sold": F.col("units_sold").cast("string"),
        "Discount_Applied": F.col("discount_applied").cast("string"),
        "Revenue": F.when(F.col("l_orderkey") % 83 == 0, "NaN").otherwise(F.col("revenue").cast("string")),
        "Channel": F.lit("web"),
    }
    for number, header in enumerate((FIRST, SECOND)):
        short = F.concat_ws(",", *[values[c] for c in header[:-1]])
        line = F.when(F.col("l_orderkey") % 97 == 0, short).otherwise(F.concat_ws(",", short, values[header[-1]]))
        lines = df.filter(F.col("l_orderkey") % 2 == number).select(line.alias("value"))
        # A header on top of every file, as a writer of that layout would put it.
        name = ",".join(header)
        headed = lines.mapInArrow(_with_header(name), "value string")
        headed.write.mode("append").text(path)
    return path


def _with_header(name: str):
    import pyarrow as pa

    def run(batches):
        begun = False
        for batch in batches:
            if not begun:
                yield pa.RecordBatch.from_arrays([pa.array([name], batch.schema.field(0).type)], schema=batch.schema)
                begun = True
            yield batch

    return run


_SQL_COLUMNS = """l_orderkey || '-' || l_linenumber AS transaction_id, transaction_date, category || ', sold' AS category,
 region, units_sold, CASE WHEN l_orderkey % 2 = 0 THEN discount_applied END AS discount_applied,
 CASE WHEN l_orderkey % 83 <> 0 THEN round(revenue, 6) END AS revenue,
 CASE WHEN l_orderkey % 2 = 1 THEN 'web' END AS channel"""


@query("s1_csv_two_headers", SALES + f"SELECT {_SQL_COLUMNS} FROM sales WHERE l_orderkey % 97 <> 0 AND l_orderkey % 89 <> 0")
def s1_csv(spark, sf):
    """All lines that are transactions, whichever header their file has."""
    df = readers.read_transactions_csv(spark, _transaction_folder(spark, sf))
    names = ["transaction_id", "transaction_date", "category", "region", "units_sold", "discount_applied", "revenue", "channel"]
    return rounded(df.select(names), {"revenue": 6})


@query(
    "s1_csv_rejects",
    SALES
    + """SELECT reject_reason, line_kind, count(*) AS n FROM (SELECT
 CASE WHEN l_orderkey % 97 = 0 THEN 'line does not have 7 fields' ELSE 'transaction_date: not a date' END AS reject_reason,
 CASE WHEN l_orderkey % 97 = 0 THEN 'whole line' ELSE 'transaction_date=bad' END AS line_kind
 FROM sales WHERE l_orderkey % 97 = 0 OR l_orderkey % 89 = 0) GROUP BY 1, 2""",
)
def s1_rejects(spark, sf):
    """Lines that are no transactions, by reason and by what is kept of them."""
    from demandlens.sources.csv_files import rejected

    out = rejected(readers.check_transactions_csv(spark, _transaction_folder(spark, sf)))
    kept = F.when(F.col("line").contains(","), "whole line").otherwise(F.col("line"))
    return out.groupBy("reject_reason", kept.alias("line_kind")).agg(F.count("*").alias("n"))


@query(
    "s2_csv_requests",
    SALES
    + """SELECT region, coalesce(reject_reason, 'valid') AS outcome, count(*) AS n, round(sum(units), 2) AS units FROM (
 SELECT CASE WHEN l_orderkey % 83 <> 0 AND l_orderkey % 97 <> 0 THEN region END AS region,
  CASE WHEN l_orderkey % 97 = 0 THEN 'line does not have 11 fields'
       WHEN l_orderkey % 83 = 0 THEN 'region: missing' END AS reject_reason,
  CASE WHEN l_orderkey % 83 <> 0 AND l_orderkey % 97 <> 0 THEN units_sold END AS units
 FROM sales) GROUP BY 1, 2""",
)
def s2_csv(spark, sf):
    """Scoring requests from two CSV layouts, checked: valid ones and the reasons of the others."""
    df = sales(spark, sf, ["category", "region"])
    path = shared_folder(spark, "requests-csv")
    names = [readers.request_name(c) for c in schemas.REQUEST_FIELDS]
    fields = {n: F.lit("1.5") for n in names} | {
        "Transaction_Date": F.col("transaction_date").cast("string"),
        "Category": F.concat(F.lit('"'), F.col("category"), F.lit('"')),
        "Region": F.when(F.col("l_orderkey") % 83 == 0, "").otherwise(F.col("region")),
        "Units_Sold": F.col("units_sold").cast("string"),
    }
    del fields["Impressions"]
    names = [n for n in names if n != "Impressions"]
    for number, header in enumerate((names, names[::-1])):
        header = header[:4] + ["Impressions"] + header[4:]
        values = fields | {"Impressions": F.lit("100")}
        line = F.concat_ws(",", *[values[c] for c in header])
        cut = F.when(F.col("l_orderkey") % 97 == 0, F.lit("one,two")).otherwise(line)
        rows = df.filter(F.col("l_orderkey") % 2 == number).select(cut.alias("value"))
        rows.mapInArrow(_with_header(",".join(header)), "value string").write.mode("append").text(path)
    checked = readers.validate_requests(readers.read_requests_csv(spark, path))
    valid = F.when(F.col("reject_reason").isNull(), F.col("units_sold"))
    region = F.when(~F.coalesce(F.col("reject_reason").startswith("line"), F.lit(False)), F.col("region"))
    out = checked.groupBy(region.alias("region"), F.coalesce("reject_reason", F.lit("valid")).alias("outcome"))
    return rounded(out.agg(F.count("*").alias("n"), F.sum(valid).alias("units")), 2)
