"""Pages into records: tables of published articles, price pages, and lists of search results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.classify import title_category
from lodestrata.functions.labels import looks_like_address, stage_in
from lodestrata.functions.text import ALL_DISTRICTS, absolute_link, article_title, bare_district, campus_key, district_in_label, district_key, first_match, html_text, listing_link, price_number, table_grid, title_of, trim_all, year_in
from lodestrata.operators.dedupe import carry_forward, first_seen

# Fixed values of the data: what the headers of the published tables say, and names that are no school.
NAME_HEADER, CAMPUS_HEADER, ADDRESS_HEADER, NATURE_HEADER = "学校名称|^名称$", "^校区$", "学校地址", "学校性质|办学性质|性质"
NO_NAME = "学校名称|合计|备注|说明"
INDEX_DISTRICTS = tuple("浦东新区" if d == "浦东" else d for d in ALL_DISTRICTS)
# Fixed values of the data: how a price page marks its name, its district, its address and its average price, and how a search page links its results.
PRICE_NAME = r'(?is)<h1[^>]*class="[^"]*\bsituationHead\b[^"]*"[^>]*>(.*?)</h1>'
PRICE_CRUMB = r'(?i)<a href="/district/[^"]+\?city=sh">([^<]+)</a>'
PRICE_ADDRESS = "地址：([^<]+)"
PRICE_BLOCK = r'(?i)<p>\s*平均房价\s*<span[^>]*>（([^）]+)）</span>\s*</p>\s*<div class="fl">\s*<span[^>]*>([\d,]+)</span>\s*元/㎡'
RESULT_LINK = r'(?is)<a[^>]+href="[^"]*/community/[^"]+?city={city}[^"]*"[^>]*>.*?</a>'
#: Rows that a header may be stacked over.
HEADER_ROWS = 3


def column_of(rows: list[Column], pattern: str) -> Column:
    """The first column in which any of the stacked header rows matches a pattern, from 0; -1 if none does."""
    width = F.greatest(*[F.size(r) for r in rows], F.lit(1))
    found = F.transform(F.sequence(F.lit(0), width - 1), lambda c: F.exists(F.array(*[F.coalesce(F.get(r, c), F.lit("")) for r in rows]), lambda cell: cell.rlike(pattern)))
    return (F.array_position(found, F.lit(True)) - 1).cast("int")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression that uses a value several times and evaluates it once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def header_of(grid: Column) -> Column:
    """Where the header of a grid begins and which columns play which part; null without name and address columns.

    The first place counts where three rows in a row name the school and its address. Columns are looked for only there.
    """
    def at(i: Column) -> Column:
        rows = [F.coalesce(F.get(grid, i + k), F.array().cast("array<string>")) for k in range(HEADER_ROWS)]
        parts = {"name": NAME_HEADER, "campus": CAMPUS_HEADER, "address": ADDRESS_HEADER, "nature": NATURE_HEADER}
        found = F.struct(i.alias("row"), *[column_of(rows, p).alias(n) for n, p in parts.items()])
        return F.when(F.concat_ws(" ", *rows).rlike("学校地址"), found)  # which names a school as well

    heads = F.transform(F.sequence(F.lit(0), F.greatest(F.size(grid) - 1, F.lit(0))), at)
    return F.get(F.filter(heads, lambda h: h.isNotNull() & (h["name"] >= 0) & (h["address"] >= 0)), F.lit(0))


def _records(grid: Column, title: Column) -> Column:
    """The records of one grid below its header; none without a header."""
    def record(cells: Column, h: Column) -> Column:
        def cell(part: str) -> Column:
            return F.coalesce(F.when(h[part] >= 0, F.get(cells, h[part])), F.lit(""))

        campus = campus_key(cell("campus"))
        name = _let(campus, lambda c: F.when((c != "") & ~cell("name").contains(c), F.concat(cell("name"), F.lit("（"), c, F.lit("校区）"))).otherwise(cell("name")))
        stage = stage_in(F.concat_ws(" ", title, F.array_join(cells, " ")))
        return F.struct(stage.alias("stage"), name.alias("name"), campus.alias("campus"), cell("nature").alias("nature"), cell("address").alias("address"))

    def below(g: Column, h: Column) -> Column:
        rows = F.transform(F.slice(g, h["row"] + 2, F.greatest(F.size(g), F.lit(1))), lambda cells: record(cells, h))
        return F.filter(rows, lambda r: (r["name"] != "") & looks_like_address(r["address"]) & ~r["name"].rlike(NO_NAME))

    return _let(grid, lambda g: _let(header_of(g), lambda h: F.when(h.isNotNull(), below(g, h))))


def article_records(pages: DataFrame, html: str = "html", title: str = "title", district: str = "district", url: str = "url") -> DataFrame:
    """Schools of the tables in published articles: district, stage, name, campus, nature, address, source_title, source_url.

    Columns are found by what stacked header rows say. A campus is added to the name unless the name
    holds it. Rows without a name or an address, and rows of sums and notes, are left out; a null page has none.
    """
    own = pages.select(F.col(district).alias("district"), F.col(url).alias("source_url"), F.coalesce(F.nullif(article_title(F.col(html)), F.lit("")), F.col(title)).alias("source_title"), F.col(html).alias("__html"))
    tables = own.select("district", "source_url", "source_title", F.explode(F.regexp_extract_all("__html", F.lit(r"(?is)<table\b.*?</table>"), F.lit(0))).alias("__table"))
    clean = F.transform(table_grid("__table"), lambda row: F.transform(row, lambda x: F.regexp_replace(x, "^[-—]+$", "")))
    grid = F.filter(clean, lambda row: F.exists(row, lambda x: x != ""))
    found = tables.select("district", "source_url", "source_title", F.explode(_records(grid, F.col("source_title"))).alias("r"))
    return found.select("district", "r.stage", "r.name", "r.campus", "r.nature", "r.address", "source_title", "source_url")


def committee_inventory(schools: DataFrame, school: str, committees: str) -> DataFrame:
    """(school, is_total, n, n_unique): committees of each school and of all, unique ones without the note that only a part belongs.

    Schools without any are counted with 0. Distinct names are counted per school and over all in one pass.
    """
    rows = schools.select(F.col(school).alias("school"), F.explode_outer(committees).alias("__c"))
    plain = trim_all(F.replace(F.col("__c"), F.lit("（部分）"), F.lit("")))
    return rows.withColumn("__u", plain).rollup("school").agg(F.grouping("school").cast("boolean").alias("is_total"), F.count("__c").alias("n"), F.count_distinct("__u").alias("n_unique"))


def price_page(page: Column) -> Column:
    """A price page as a struct: name, address, district, period, price (whole yuan a square metre), problem.

    ``problem`` tells what is missing, null where the page is usable; the price is null then.
    """
    head = first_match(page, PRICE_NAME)
    name = F.nullif(trim_all(F.regexp_replace(F.regexp_replace(html_text(head), r"房价\s*（住宅）$", ""), "房价$", "")), F.lit(""))
    crumb = first_match(page, PRICE_CRUMB)
    amount = first_match(page, PRICE_BLOCK, 2)
    price = price_number(amount).cast("long")
    problem = F.when(name.isNull(), "missing community name").when(amount.isNull(), "missing average price block").when(price.isNull(), F.concat(F.lit("invalid unit price "), amount))
    return F.struct(
        name.alias("name"), html_text(first_match(page, PRICE_ADDRESS)).alias("address"), F.coalesce(bare_district(html_text(crumb)), district_in_label(html_text(title_of(page)))).alias("district"),
        F.nullif(trim_all(first_match(page, PRICE_BLOCK, 1)), F.lit("")).alias("period"), price.alias("price"), problem.alias("problem"),
    )


def search_candidates(page: Column, host: str, old_host: str, city: str = "sh") -> Column:
    """The results of a search page in page order: (url, label, district)."""
    anchors = F.regexp_extract_all(page, F.lit(RESULT_LINK.replace("{city}", city)), F.lit(0))

    def one(a: Column) -> Column:
        label = html_text(F.regexp_extract(a, r"(?s)^<a[^>]*>(.*)</a>$", 1))
        return F.struct(listing_link(F.regexp_extract(a, r'(?i)href="([^"]*)"', 1), host, old_host, city).alias("url"), label.alias("label"), district_in_label(label).alias("district"))

    return F.transform(anchors, one)


def index_sources(pages: DataFrame, key: str, html: str, url: str, fallback_year: int) -> DataFrame:
    """Sources that official index pages list: (key, ordinal, year, district, title, url, category, confidence), the first of each.

    A row of the index that names a district gives it to the rows after it, up to the next one; anchors before the
    first are left out. An anchor's target is the page it opens, else its reference, resolved against the page's URL.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("page_url"), F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr.*?</tr>"), F.lit(0))).alias("n_row", "row"))
    named = first_match(html_text(F.col("row")), f"({'|'.join(INDEX_DISTRICTS)})区?")
    rows = rows.withColumn("own", district_key(named))
    rows = rows.withColumn("district", carry_forward(rows, ["key"], "n_row", "own")).filter("district is not null")  # a page's rows
    anchors = rows.select("key", "page_url", "n_row", "district", F.posexplode(F.regexp_extract_all("row", F.lit(r"(?is)<a\b.*?</a>"), F.lit(0))).alias("n", "a"))
    title = F.regexp_replace(F.regexp_replace(html_text(F.col("a")), "^《", ""), "》$", "")
    target = F.coalesce(first_match(F.col("a"), r"(?i)window\.open\(['\"]([^'\"]+)['\"]"), F.nullif(first_match(F.col("a"), r"(?i)\shref=[\"']([^\"']+)[\"']"), F.lit("#")))
    category = title_category(F.col("title"))
    found = anchors.select("key", "district", (F.col("n_row").cast("long") * 10_000 + F.col("n")).alias("ordinal"), title.alias("title"), absolute_link(target, F.col("page_url")).alias("url")).filter("title <> ''")
    found = found.withColumn("year", year_in(F.col("title"), F.lit(fallback_year))).withColumn("category", category).withColumn("confidence", F.when(category == "service", "medium").otherwise("high"))
    return first_seen(found, ["key", "year", "district", "url", "title", "category"], "ordinal")
