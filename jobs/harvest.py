"""A catalogue of what portals list, kept up to date from saved listing pages as they arrive.

    python -m jobs.harvest INPUT OUTPUT [--config settings.json]

Portals show holdings as pages of links.  Each page (page_id, url, html) tells its site (the
host, without ``www.`` and ``m.``), its section (the first part of the path) and its entries (the
targets of its links, without query and fragment).  The job keeps, for each site, section and entry, the number of pages
that list it and the first and last of them, and tells which sites have all ``sections``.

Pages are a stream of files: each run takes those that the checkpoint doesn't have, in
batches, and ends when there are none left.

    OUTPUT/<digest>/checkpoint   what has been taken
    OUTPUT/<digest>/found        sums of each batch, partitioned by shelf and batch
    OUTPUT/<digest>/entries      the catalogue, partitioned by shelf
    OUTPUT/<digest>/sites        a row per site: entries, pages, which sections, partitioned by shelf
    OUTPUT/<digest>/marks        the last batch that the catalogue has, partitioned by shelf

The digest is of the settings that shape the output.  A shelf is the first ``digits`` hexadecimal digits of the md5 of the site.  A batch that
is run again replaces its own sums.  After the batches, the shelves with a batch beyond their mark are
summed anew, from ``found`` alone, and replaced as a whole; marks come last, so a run that was stopped anywhere is
made good by the next.  Pages are never read again; sums are read only of the shelves that
a new batch touched.  A site of any size is summed before it is exchanged.

Pages without a host, or without links, list nothing and are only counted; null html has no links; a link without
a closing quote is none; the empty target is an entry like others; a link that occurs twice on a page counts once for
it; rows that share a page_id are pages of their own; a null page_id is counted and is neither first
nor last unless all are null.  No input gives empty output.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isopycna.operators import catalog
from isopycna.plans import runs
from isopycna.sources import results, scratch

from .common import command, saved, settings

log = logging.getLogger("jobs.harvest")
DEFAULT = "harvest.json"
PAGES = "page_id long, url string, html string"
FOUND = "site string, section string, entry string, n_pages long, first_page long, last_page long, shelf string, batch long"
ENTRIES = "site string, section string, entry string, n_pages long, first_page long, last_page long, shelf string"
MARKS = "last_batch long, shelf string"
LINK = '<a href="'
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:(?:www|m)\.)?([^/?#:]+)"
SECTION = r"^[^:]+://[^/?#]+/([^/?#]*)"


def site(url: Column) -> Column:
    """The host of a URL without its ``www.`` or ``m.``; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def targets(html: Column) -> Column:
    """The distinct targets of the links of a page."""
    # What follows each opening of a link, up to the quote that closes it.
    after = F.filter(F.slice(F.split(html, LINK), 2, 1 << 30), lambda x: F.contains(x, F.lit('"')))
    return F.array_distinct(F.transform(after, lambda x: F.substring_index(F.substring_index(F.substring_index(x, '"', 1), "#", 1), "?", 1)))


def listed(pages: DataFrame, digits: int) -> DataFrame:
    """The sums of ``pages`` by site, section and entry, with the shelf of the site."""
    rows = pages.select("page_id", site(F.col("url")).alias("site"), F.regexp_extract("url", SECTION, 1).alias("section"), F.explode(targets(F.col("html"))).alias("entry"))
    each = rows.where("site is not null").groupBy("site", "section", "entry")
    sums = each.agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"), F.max("page_id").alias("last_page"))
    return sums.withColumn("shelf", F.substring(F.md5("site"), 1, digits))


def take(spark: SparkSession, source: str, output: str, config: dict) -> dict:
    """Read the pages that have come since the last run, batch by batch; gives how many pages and batches.

    Pages are counted by the stream, which keeps its last hundred batches.
    """
    pages = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(source)

    def put(batch: DataFrame, number: int) -> None:
        rows = saved(listed(batch, config["digits"]).withColumn("batch", F.lit(number).cast("long")), f"{output}/found", ("shelf", "batch"))
        log.info("batch %d: wrote %d sums to %s/found", number, rows, output)

    query = pages.writeStream.foreachBatch(put).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    progress = [p for p in query.recentProgress if p.numInputRows]
    return {"pages": sum(p.numInputRows for p in progress), "batches": len(progress)}


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return results.load(spark, path, spark.createDataFrame([], schema).schema)


def fold(spark: SparkSession, output: str, config: dict) -> dict:
    """Bring the catalogue up to the last batch; gives the rows written."""
    found = read(spark, f"{output}/found", FOUND)
    have = found.groupBy("shelf").agg(F.max("batch").alias("last_batch"))
    marks = read(spark, f"{output}/marks", MARKS).withColumnRenamed("last_batch", "done")
    behind = have.join(marks, "shelf", "left").where(F.col("done").isNull() | (F.col("done") < F.col("last_batch")))
    # Kept, for the marks that it depends on are replaced from it.
    behind.select("last_batch", "shelf").write.mode("overwrite").parquet(f"{output}/behind")
    behind = read(spark, f"{output}/behind", MARKS)
    only = behind.select("shelf")
    sums = found.join(only, "shelf", "left_semi").groupBy("shelf", "site", "section", "entry")
    sums = sums.agg(F.sum("n_pages").alias("n_pages"), F.min("first_page").alias("first_page"), F.max("last_page").alias("last_page"))
    entries = sums.select("site", "section", "entry", "n_pages", "first_page", "last_page", "shelf")
    wrote = {"entries": saved(entries, f"{output}/entries", ("shelf",))}
    again = read(spark, f"{output}/entries", ENTRIES).join(only, "shelf", "left_semi")
    wrote["sites"] = saved(sites(again, config["sections"]), f"{output}/sites", ("shelf",))
    wrote["shelves"] = saved(behind, f"{output}/marks", ("shelf",))
    return wrote


def sites(entries: DataFrame, sections: list[str]) -> DataFrame:
    """A row per site: how much it lists, which of ``sections`` it has (0 or 1), and whether it has them all."""
    holds = entries.select(F.col("site").alias("model"), F.col("section").alias("variable"))
    matrix = catalog.availability(holds, tuple(sections)).select(F.col("model").alias("site"), *(F.col(s).alias(f"has_{s}") for s in sections))
    complete = catalog.with_all(holds, tuple(sections)).select(F.col("model").alias("site"), F.lit(True).alias("complete"))
    sizes = entries.groupBy("shelf", "site").agg(F.countDistinct("entry").alias("n_entries"), F.sum("n_pages").alias("n_listed"))
    out = sizes.join(matrix, "site").join(complete, "site", "left").fillna(False, ["complete"])
    return out.select("site", "n_entries", "n_listed", *(f"has_{s}" for s in sections), "complete", "shelf")


def place(output: str, config: dict) -> str:
    return f"{output.rstrip('/')}/{runs.fingerprint({k: config[k] for k in ('sections', 'digits')})[:12]}"


def checked(config: dict) -> None:
    if not (isinstance(config["digits"], int) and 0 < config["digits"] <= 4):
        raise ValueError("digits must be a whole number from 1 to 4")
    if not config["sections"] or len(set(config["sections"])) < len(config["sections"]):
        raise ValueError("sections must be different names, at least one")
    if not (isinstance(config["files_per_batch"], int) and config["files_per_batch"] > 0):
        raise ValueError("files_per_batch must be a whole number above 0")


def run(spark: SparkSession, source: str, output: str, config: dict) -> dict:
    """One run over the pages in ``source``, a folder that grows; gives the numbers of pages, batches and rows."""
    checked(config)
    out = place(output, config)
    # A pattern, for the pages may be one file as well as a folder of files.
    took = take(spark, f"{source.rstrip('/')}/pages.parquet*", out, config)
    log.info("read %d pages in %d batches of %s", took["pages"], took["batches"], source)
    wrote = fold(spark, out, config)
    log.info("wrote %d entries and %d sites of %d shelves to %s", wrote["entries"], wrote["sites"], wrote["shelves"], out)
    return took | wrote


def catalogue(spark: SparkSession, output: str, config: dict) -> DataFrame:
    """The entries as they stand, each beside what is known of its site."""
    out, sections = place(output, config), config["sections"]
    columns = ["n_entries long", "n_listed long", *(f"has_{s} int" for s in sections), "complete boolean"]
    known = read(spark, f"{out}/sites", ", ".join(["site string", *columns, "shelf string"]))
    return read(spark, f"{out}/entries", ENTRIES).join(known.drop("shelf"), "site")


def job2_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs into one new folder and checkpoint, the second of which finds nothing new, and the whole catalogue after them."""
    out, config = scratch.folder(spark), settings(None, DEFAULT)
    for _ in range(2):
        run(spark, sf_dir, out, config)
    return catalogue(spark, out, config)


SQL = r"""with links as (select page_id, url, unnest(list_distinct(regexp_extract_all(html, '<a href="([^"?#]*)[^"]*"', 1))) entry from pages),
placed as (select page_id, entry, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:(?:www|m)\.)?([^/?#:]+)', 1)) site, regexp_extract(url, '^[^:]+://[^/?#]+/([^/?#]*)', 1) section from links),
entries as (select site, section, entry, count(*) n_pages, min(page_id) first_page, max(page_id) last_page, substr(md5(site), 1, 1) shelf from placed where site <> '' group by site, section, entry),
known as (select site, count(distinct entry) n_entries, cast(sum(n_pages) as bigint) n_listed, cast(max(section = 'de') as int) has_de, cast(max(section = 'en') as int) has_en,
  cast(max(section = 'es') as int) has_es, cast(max(section = 'fr') as int) has_fr, count(distinct section) filter (section in ('de', 'en', 'es', 'fr')) = 4 complete from entries group by site)
select entries.*, n_entries, n_listed, has_de, has_en, has_es, has_fr, complete from entries join known using (site)"""

QUERIES = {"job2_harvest": job2_harvest}
ORACLES = {"job2_harvest": SQL}

if __name__ == "__main__":
    command(run, DEFAULT, "A catalogue of what portals list, from saved pages as they arrive.")
