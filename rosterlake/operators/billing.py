"""Fees per confirmed creator: unbilled counts, invoices, receivables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.operators.scale import cumulative_counts
from rosterlake.vocab import words

MONEY = "decimal(18,2)"


def unbilled(creators: DataFrame) -> DataFrame:
    """Confirmed creators not billed yet, counted per campaign."""
    due = creators.where(~F.col("billed") & F.col("status").isin(*words.COMMITTED_STATUSES))
    return due.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("creators"))


def billing_run(campaigns: DataFrame, creators: DataFrame, orgs: DataFrame, invoices: DataFrame, as_of: Column) -> DataFrame:
    """One invoice per launched campaign with unbilled creators.

    ``campaigns``: id, org_id, name, status; ``orgs``: org_id, fee_per_creator; ``invoices``: the ones issued so far.
    Numbers continue each organisation's sequence of the year in campaign order.
    """
    todo = unbilled(creators)
    launched = campaigns.where(F.col("status").isin("active", "completed"))
    year = F.year(as_of).cast("string")
    prefix = F.concat(F.lit("CA-"), year, F.lit("-"), F.lpad(F.col("org_id").cast("string"), 3, "0"), F.lit("-"))
    issued = (invoices.where(F.col("number").startswith(F.concat(F.lit("CA-"), year, F.lit("-")))).groupBy("org_id")
              .agg(F.count(F.lit(1)).alias("_issued")))
    fee = F.coalesce(F.nullif(F.col("fee_per_creator"), F.lit(0)), F.lit(words.FEE_PER_CREATOR)).cast(MONEY)
    bills = (launched.join(todo, launched["id"] == todo["campaign_id"]).drop("campaign_id")
             .join(orgs, "org_id", "left").join(issued, "org_id", "left")
             .withColumn("unit_price", fee).withColumn("subtotal", (F.col("unit_price") * F.col("creators")).cast(MONEY))
             .withColumn("tax", F.round(F.col("subtotal") * F.lit(words.TAX_RATE).cast("decimal(4,2)"), 2).cast(MONEY)))
    # place in the organisation's sequence: campaigns before it, counted without gathering an organisation
    earlier = cumulative_counts(bills.select("org_id", "id"), ["org_id"], "id").select(
        "org_id", F.col("value").alias("id"), F.col("before").alias("_before"))
    place = F.col("_before") + 1 + F.coalesce("_issued", F.lit(0))
    return bills.join(earlier, ["org_id", "id"]).withColumn("_place", place).select(
        "org_id", F.col("id").alias("campaign_id"), F.concat(prefix, F.lpad(F.col("_place").cast("string"), 4, "0")).alias("number"),
        F.lit("issued").alias("status"), as_of.alias("issued_at"),
        (as_of + F.make_dt_interval(F.lit(words.DUE_DAYS))).alias("due_at"), F.col("creators").alias("qty"), "unit_price",
        "subtotal", F.lit(words.TAX_RATE).alias("tax_rate"), "tax", (F.col("subtotal") + F.col("tax")).cast(MONEY).alias("total"),
        F.concat(F.lit("Platform service fee — "), "name", F.lit(" ("), F.col("creators").cast("string"), F.lit(" confirmed creator"),
                 F.when(F.col("creators") != 1, "s").otherwise(""), F.lit(")")).alias("description"))


def mark_billed(creators: DataFrame, bills: DataFrame) -> DataFrame:
    """Shortlist after a billing run: what was invoiced is marked."""
    paid_for = bills.select("campaign_id").distinct().withColumn("_invoiced", F.lit(True))
    joined = creators.join(paid_for, "campaign_id", "left")
    now = F.coalesce("_invoiced", F.lit(False)) & F.col("status").isin(*words.COMMITTED_STATUSES)
    return joined.withColumn("billed", F.col("billed") | now).drop("_invoiced").select(*creators.columns)


def receivables(invoices: DataFrame, lines: DataFrame, as_of: Column) -> DataFrame:
    """Outstanding, overdue, paid and creators billed, per organisation."""
    qty = lines.groupBy(F.col("invoice_id").alias("id")).agg(F.sum("qty").alias("creators"))
    status = F.col("status")
    late = (status == "issued") & (F.coalesce("due_at", F.lit("1970-01-01").cast("timestamp_ntz")) < as_of)
    def money(test):
        return F.coalesce(F.sum(F.when(test, F.col("total"))), F.lit(0).cast(MONEY))
    return invoices.join(qty, "id", "left").groupBy("org_id").agg(
        F.count(F.lit(1)).alias("invoices"), money(status == "issued").alias("outstanding"), money(late).alias("overdue"),
        money(status == "paid").alias("paid"),
        F.sum(F.when(status != "void", F.coalesce("creators", F.lit(0))).otherwise(0)).alias("creators_billed"))


def pending_campaigns(campaigns: DataFrame, creators: DataFrame) -> DataFrame:
    """Active campaigns with creators still to bill."""
    todo = unbilled(creators)
    return campaigns.where(F.col("status") == "active").join(todo, campaigns["id"] == todo["campaign_id"]).select(
        F.col("id").alias("campaign_id"), "org_id", "creators")


def invoice_documents(invoices: DataFrame, lines: DataFrame, payments: DataFrame) -> DataFrame:
    """Invoice documents, one row per line or payment next to its invoice (I10). ``lines`` and ``payments`` carry
    ``invoice_id`` and ``id``; an invoice without either keeps one row. Rows are never nested, as one invoice may have
    very many lines."""
    def entries(df, part):
        return df.withColumnRenamed("id", "part_id").withColumn("part", F.lit(part))
    parts = entries(lines, "line").unionByName(entries(payments, "payment"), allowMissingColumns=True)
    return invoices.join(parts.withColumnRenamed("invoice_id", "id"), "id", "left")
