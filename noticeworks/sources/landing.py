"""Landed feeds and tables as DataFrames. The network stays outside: a fetcher writes pages of JSON to a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticeworks.functions import dates
from noticeworks.functions.text import fold, html_to_text, slug, to_latin

CENTRAL = "id long, vrstaPredmeta string, vrstaPredmetaSifra string, naslov string, naslovL string, naslovC string, datumObjave string, datumProdaje string, insId long, institucija string, RB long, total long"
ARTICLES = "id long, header string, subheader string, date string, description string, content string, url string, insId long, institucija string, details struct<dokumenti:array<struct<id:long,naziv:string,tipDocLower:string>>>"
LISTING = (
    "id string, article_id long, court string, court_id long, entity string, case_number string, sale_type string, title string, headline string, item_description string, item_tags array<string>, "
    "cadastral struct<kc:array<string>,zk_ulozak:array<string>,ko:array<string>>, location struct<municipality:string,settlement:string>, appraised_value struct<amount:double,currency:string>, "
    "starting_price struct<amount:double,currency:string>, deposit struct<amount:double,currency:string>, auction_round string, sale_method string, sale_date date, sale_time string, auction_location string, "
    "viewing_info string, published_date date, source_url string, documents array<struct<id:long,name:string,type:string,url:string,sha256:string>>, language string, "
    "extraction struct<pipeline_version:string,source:string,confidence:double,llm:boolean>, scraped_at timestamp"
)
COVERAGE = "id long, name string, entity string, centralCount long, categoryCount long, categories array<struct<id:long,name:string,total:long>>, route string"


def central_feed(spark: SparkSession, path: str) -> DataFrame:
    """Rows of landed central pages, the first of each id; pages repeat rows at their bounds."""
    rows = spark.read.schema(CENTRAL).json(path, multiLine=True).withColumn("_file", F.input_file_name())
    rest = [c for c in rows.columns if c not in ("id", "_file")]
    return rows.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("_file", "RB")).alias("r")).select("id", "r.*")


def category_feed(spark: SparkSession, path: str, limit: int = 400) -> DataFrame:
    """Articles of landed category pages (one folder a category), no more than ``limit`` of each, in the feed's order."""
    rows = spark.read.schema(ARTICLES).json(path, multiLine=True)
    file = F.input_file_name()
    page = F.regexp_extract(file, r"([0-9]+)[^/0-9]*\z", 1).try_cast("long")
    rows = rows.select("*", F.regexp_extract(file, r"([^/]+)/[^/]+\z", 1).alias("category"), page.alias("_page"), file.alias("_file"), F.monotonically_increasing_id().alias("_seq"))  # a file is read by one task, from its start
    return rows.withColumn("_r", F.row_number().over(W.partitionBy("category").orderBy("_page", "_file", "_seq"))).where(F.col("_r") <= limit).withColumn("seq", F.col("_r")).drop("_r", "_seq", "_page", "_file")


def is_sale_category(name: Column) -> Column:
    return fold(F.coalesce(name, F.lit(""))).rlike("prodaj|licitacij|nadmetanj|drazb")


def sale_categories(pages: DataFrame, html: str = "html") -> DataFrame:
    """Sale categories of a navigation tree in a page's JSON: all children of a parent that matches, else the children that do."""
    node = "struct<id:long,name:string>"
    tree = f"array<struct<id:long,name:string,categories:array<struct<id:long,name:string,subcategories:array<{node}>>>>>"
    raw = F.regexp_extract(F.col(html), r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    data = F.from_json(raw, f"struct<props:struct<pageProps:struct<modules:{tree}>>>")
    m = pages.select(F.explode_outer(data["props"]["pageProps"]["modules"]).alias("m")).select(F.explode("m.categories").alias("c"))
    own = is_sale_category(F.col("c.name"))
    children = F.coalesce(F.col("c.subcategories"), F.array().cast(f"array<{node}>"))
    picked = F.when(own & (F.size(children) == 0), F.array(F.struct(F.col("c.id").alias("id"), F.col("c.name").alias("name")))).when(own, children).otherwise(F.filter(children, lambda x: is_sale_category(x["name"])))
    return m.select(F.explode(picked).alias("x")).select("x.id", "x.name").distinct()


def coverage(spark: SparkSession, path: str) -> DataFrame:
    """One row for each category of each institution in the registry; without the file, no row."""
    try:
        return spark.read.schema(COVERAGE).json(path, multiLine=True).withColumn("category", F.explode_outer("categories")).drop("categories")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], COVERAGE).withColumn("category", F.explode_outer("categories")).drop("categories")


def entity_of(court: Column) -> Column:
    """The entity by a court's name; names that tell nothing are taken for the federation's."""
    n = fold(to_latin(court))
    return F.when(n.contains("brcko"), "BD").when(n.rlike("kantonaln|opcinsk|federacij"), "FBiH").when(n.rlike("okruzn|osnovn|republike srpske|privredn"), "RS").otherwise("FBiH")


def courts(df: DataFrame, court_id: str = "court_id", name: str = "court", seq: str = "seq") -> DataFrame:
    """The court dimension of rows: the last name seen, its slug and entity, and how many rows it has."""
    clean = F.trim(F.regexp_replace(name, r"\s+", " "))
    out = df.groupBy(court_id).agg(F.max_by(clean, F.col(seq)).alias("name"), F.count("*").alias("n"))
    return out.withColumn("slug", slug(F.col("name"))).withColumn("entity", entity_of(F.col("name"))).orderBy(F.collate("name", "bs"))


def candidates(central: DataFrame, articles: DataFrame) -> DataFrame:
    """Both feeds as one, the first of each article: the central row wins, as it knows date and kind of the sale."""
    a = central.select(
        F.col("id").alias("article_id"), F.col("insId").alias("court_id"), F.col("institucija").alias("court"), F.coalesce("naslov", "naslovL", F.lit("")).alias("title"), F.lit(None).cast("string").alias("inline"),
        F.col("vrstaPredmetaSifra").alias("type_code"), F.col("vrstaPredmeta").alias("type_label"), dates.parse_date(F.col("datumObjave")).alias("published_date"), dates.parse_date(F.col("datumProdaje")).alias("sale_date"), F.lit(0).alias("src_rank"),
    )
    b = articles.select(
        F.col("id").alias("article_id"), F.col("insId").alias("court_id"), F.col("institucija").alias("court"), F.coalesce("header", F.lit("")).alias("title"), F.concat_ws("\n", F.nullif("description", F.lit("")), F.nullif("content", F.lit(""))).alias("inline"),
        F.lit(None).cast("string").alias("type_code"), F.lit(None).cast("string").alias("type_label"), dates.parse_date(F.col("date")).alias("published_date"), F.lit(None).cast("date").alias("sale_date"), F.lit(1).alias("src_rank"), (F.col("seq") if "seq" in articles.columns else F.lit(0)).alias("_o"),
    )
    u = a.withColumn("_o", F.lit(0)).unionByName(b)
    rest = [c for c in u.columns if c not in ("article_id", "_o")]
    return u.groupBy("article_id").agg(F.min_by(F.struct(*rest), F.struct("src_rank", "_o", "title")).alias("r")).select("article_id", "r.*")


def best_text(inline: Column, attachments: Column) -> Column:
    """The text a notice is read from: a long body, else the first attachment with enough in it, else a thin body.

    ``attachments`` is an array of ``struct<text, ocr, scanned>`` in order; gives ``struct<text, source>``.
    """
    body = html_to_text(inline)
    chars = lambda c: F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", ""))
    tried = F.transform(attachments, lambda a: F.when(a["scanned"] & (chars(a["ocr"]) > 120), F.struct(a["ocr"].alias("text"), F.lit("ocr").alias("source"))).when(chars(a["text"]) > 120, F.struct(a["text"].alias("text"), F.lit("document").alias("source"))))
    found = F.get(F.array_compact(tried), 0)
    thin = F.when(chars(body) > 0, F.struct(body.alias("text"), F.lit("inline").alias("source"))).otherwise(F.struct(F.lit("").alias("text"), F.lit("none").alias("source")))
    return F.when(chars(body) > 600, F.struct(body.alias("text"), F.lit("inline").alias("source"))).otherwise(F.coalesce(found, thin))


def query_string(params: dict) -> str:
    """For a fetcher: parameters without null and empty ones."""
    from urllib.parse import urlencode

    return urlencode({k: v for k, v in params.items() if v is not None and v != ""})
