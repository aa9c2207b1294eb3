"""Attribution of the data that a job used: provider strings joined with a table of licences by what they contain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import written

#: Lines that one number marks.
BITS = 62
# Source, licence line and the texts that tell it (in any case); a source without texts is always named.
LICENCES = (
    ("OpenStreetMap", "© OpenStreetMap contributors, licensed under the Open Database License (ODbL)", ("OpenStreetMap",)),
    ("Lantmäteriet", "open data under CC0 1.0 via the Lantmäteriet open data programme", ("Lantmäteriet", "Hydrografi", "Marktäcke", "STAC")),
    ("Sentinel-2 Cloudless", "Contains modified Copernicus Sentinel data 2024, processed by EOX IT Services GmbH", ("Sentinel-2", "EOX")),
    ("Copernicus DEM GLO-30", "© DLR e.V. 2010-2014 and © Airbus Defence and Space GmbH 2014-2018, provided under the Copernicus Data License", ("Copernicus DEM", "COP30", "AWS")),
    ("OpenTopography", "SRTM / COP30 access via OpenTopography.org", ("OpenTopography",)),
    ("ALOS World 3D 30 m", "© JAXA, distributed via the JAXA Earth Observation Research Center", ("ALOS",)),
    ("Kartverket", "open data under NLOD 2.0", ("Kartverket",)),
    ("Maa-amet", "Maa-amet open data terms", ("Maa-amet",)),
    ("NLS Finland", "open data under the NLS open data licence", ("NLS",)),
    ("Dataforsyningen", "open data via Dataforsyningen", ("Dataforsyningen",)),
    ("GUGiK", "open data via GUGiK Geoportal", ("GUGiK",)),
    ("Natural Earth", "public domain", ()),
)


def grams(text: str, size: int):
    """The distinct runs of ``size`` characters of a column; a shorter text has none."""
    n = F.length(text)
    starts = F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(F.col(text), i, F.lit(size))))


def contained(texts: DataFrame, needles: DataFrame, size: int = 3) -> DataFrame:
    """Pairs (text, needle) where a text holds a needle, letters in either case: distinct texts (text) and needles (needle).

    A needle is keyed by its first ``size`` characters, a shorter one by all of its own; a text
    offers its runs of those lengths, so an equi-join finds the candidates and the whole needle
    decides. Null and empty needles are held by none, null texts hold none.
    """
    keyed = needles.select("needle").where("needle <> ''").distinct().withColumn("_low", F.lower("needle"))
    keyed = keyed.withColumn("_key", F.substring("_low", 1, size))
    offered = texts.select("text").where("text IS NOT NULL").distinct().withColumn("_text", F.lower("text"))
    every = F.flatten(F.array(*[grams("_text", k) for k in range(1, size + 1)]))
    met = offered.withColumn("_key", F.explode(every)).join(keyed, "_key")
    return met.where(F.contains("_text", "_low")).select("text", "needle")


def attribution(used: DataFrame, licences: tuple = LICENCES) -> DataFrame:
    """One row per licence line of a job: job, place (its number in the table), source, licence.

    ``used`` has the jobs' providers (job, provider). Each distinct provider meets the table
    once, however many jobs name it; a job gathers a bit for each line, so one aggregation of
    fixed width finds its lines. Lines come once for a job, whatever names them; those
    without texts come for every job, also one with a null provider.
    """
    spark = used.sparkSession
    table = [(i, source, licence) for i, (source, licence, _) in enumerate(licences)]
    lines = spark.createDataFrame(table, "place int, source string, licence string")
    told = [(i // BITS, 1 << i % BITS, n) for i, (*_, needles) in enumerate(licences) for n in needles]
    needles = spark.createDataFrame(told, "word int, bit long, needle string")
    words = range(len(licences) // BITS + 1)
    names = contained(used.select(F.col("provider").alias("text")), needles).join(F.broadcast(needles), "needle")
    marks = [F.bit_or(F.when(F.col("word") == w, F.col("bit"))).alias(f"_m{w}") for w in words]
    by_name = written(names.groupBy("text").agg(*marks), "licences")
    found = used.select("job", "provider").join(by_name, F.col("provider") == F.col("text"), "left")
    by_job = found.groupBy("job").agg(*[F.bit_or(f"_m{w}").alias(f"_m{w}") for w in words])
    has = lambda i: F.col(f"_m{i // BITS}").bitwiseAND(F.lit(1 << i % BITS)) != 0
    places = F.array(*[F.when(has(i), F.lit(i)) if texts else F.lit(i) for i, (*_, texts) in enumerate(licences)])
    rows = by_job.select("job", F.explode(F.array_compact(places)).alias("place"))
    return rows.join(F.broadcast(lines), "place").select("job", "place", "source", "licence")
