"""CSV exports: semicolon, CRLF, UTF-8 with a byte order mark, local headers and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landsift.functions import agent as A
from landsift.functions import text as T
from landsift.operators import traffic as R

BOM = "﻿"


def write_excel_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Every part carries the header; its first name begins with the byte order mark.

    ``one_file`` sends everything through one task and is meant for reports of a few
    hundred rows; full exports stay in parts."""
    marked = df.withColumnRenamed(df.columns[0], BOM + df.columns[0])
    if one_file:
        marked = marked.coalesce(1)
    marked.write.option("sep", ";").option("header", True).option("lineSep", "\r\n").option(
        "emptyValue", ""
    ).csv(path)


def request_rows(requests: DataFrame) -> DataFrame:
    """The request log under its export headers."""
    # Headers of the export.
    columns = {
        "ID zahteve": F.col("request_id"),
        "ID opravila": F.col("job_id"),
        "Čas zahteve": F.col("requested_at"),
        "Parcela": F.col("parcel_reference"),
        "Stanje": T.label(F.col("status"), R.STATUS_LABELS),
        "Posodobitev stanja": F.col("status_updated_at"),
        "IP naslov": F.col("ip_address"),
        "ID obiskovalca": F.coalesce("visitor_id", F.lit("")),
        "Tehnična skupina": F.col("technical_group"),
        "Vrsta naprave": T.label(F.col("device_type"), R.DEVICE_LABELS),
        "Brskalnik": A.technical_label(F.col("browser_family")),
        "Operacijski sistem": A.technical_label(F.col("os_family")),
        "Uporabniški agent": F.col("user_agent"),
        "Jezik brskalnika": F.col("accept_language"),
        "Gostitelj napotitve": F.col("referer_host"),
        "Analitično soglasje": F.when(F.col("analytics_consent"), "DA").otherwise("NE"),
        "Različica soglasja": F.coalesce("consent_version", F.lit("")),
    }
    return requests.select(*[c.alias(n) for n, c in columns.items()])


def group_rows(groups: DataFrame, by: str) -> DataFrame:
    """Request groups under their export headers."""
    # Headers of the export.
    return groups.select(
        F.lit(R.GROUP_LABELS.get(by, by)).alias("Združeno po"),
        F.col("label").alias("Skupina"),
        F.col("request_count").alias("Število zahtev"),
        F.col("unique_ips").alias("Različni IP-ji"),
        F.col("last_request").alias("Zadnja zahteva"),
    )


def report_sections_long(sections: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Several report tables as one long table: section, row, column and value.

    Each section gives its rows and the order of its columns; rows carry ``ord``."""
    whole = None
    for n, (name, (df, columns)) in enumerate(sections.items()):
        cells = F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("column_ord"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                    for i, c in enumerate(columns)
                ]
            )
        )
        part = df.select(F.lit(n).alias("section_ord"), F.lit(name).alias("section"), "ord", cells.alias("cell"))
        part = part.select("section_ord", "section", "ord", "cell.*")
        whole = part if whole is None else whole.unionByName(part)
    return whole
