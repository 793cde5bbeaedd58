"""Text and number expressions: normalization, presence, percentages. All are Columns."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Fixed values of the data: the districts in scope, all districts, and what counts as not filled in.
SCOPE_DISTRICTS = ("黄浦", "静安", "长宁", "虹口", "杨浦", "徐汇", "闵行", "浦东", "普陀")
ALL_DISTRICTS = ("黄浦", "徐汇", "长宁", "静安", "普陀", "虹口", "杨浦", "浦东", "闵行", "宝山", "嘉定", "金山", "松江", "青浦", "奉贤", "崇明")
EMPTY_VALUES = ("", "待补充", "待核验", "未知", "未入榜/待补充", "-", "—")
STAGE_SUFFIXES = ("小学部", "中学部", "初中部", "高中部")


def trim_all(c: Column) -> Column:
    """Trims every Unicode white space, not only spaces."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def district_key(c: Column) -> Column:
    """A district's short name, for grouping spellings together."""
    return F.regexp_replace(F.regexp_replace(trim_all(c), "新区$", ""), "区$", "")


def district_in_scope(c: Column) -> Column:
    """The short name, or null outside the scope."""
    return F.when(district_key(c).isin(*SCOPE_DISTRICTS), district_key(c))


def district_label(c: Column) -> Column:
    """The long name of a district in scope; other values stay as they are."""
    short = district_in_scope(c)
    return F.when(short == "浦东", F.lit("浦东新区")).when(short.isNotNull(), F.concat(short, F.lit("区"))).otherwise(c)


def present(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit("")) != ""


def meaningful(c: Column) -> Column:
    """Present, and not a stand-in for a missing value."""
    return present(c) & ~F.coalesce(c, F.lit("")).isin(*EMPTY_VALUES)


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null where Spark gives an empty string."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def year_in(c: Column, fallback: Column) -> Column:
    return F.coalesce(first_match(c, r"(20\d{2})").cast("int"), fallback)


def bracket_cut(c: Column) -> Column:
    """A trimmed name up to its first bracket of either width."""
    return F.regexp_replace(F.trim(c), r"(?s)[（(].*$", "")


def without_notes(c: Column) -> Column:
    """A text without its bracketed notes."""
    return F.regexp_replace(F.regexp_replace(c, "（[^）]*）", ""), r"\([^)]*\)", "")


def listed(c: Column, separators: str = "/、") -> Column:
    """The trimmed non-empty parts of a delimited list."""
    return F.filter(F.transform(F.split(c, f"[{separators}]"), trim_all), lambda x: x != "")


def school_key(c: Column) -> Column:
    """A school's name without markup, spaces, brackets, punctuation and the city's name; campus text stays."""
    # Fixed values of the data: what is taken out of a school's name, in this order.
    steps = ((r"<[^>]+>", ""), (r"(?U)[\s ]+", ""), ("^上海市", ""), ("[（）()]", ""), ("[：:，,。；;]", ""))
    return reduce(lambda x, step: F.regexp_replace(x, *step), steps, c)


def school_variants(c: Column) -> Column:
    """The key and its forms without a stage suffix, as an array."""
    key = school_key(c)
    shorter = [F.when(key.endswith(s), F.substring(key, F.lit(1), F.length(key) - len(s))) for s in STAGE_SUFFIXES]
    return F.array_distinct(F.filter(F.array(key, *shorter), lambda x: x.isNotNull() & (x != "")))


def community_aliases(c: Column) -> Column:
    """A community's name and what is left when phase and zone suffixes are peeled off, up to three times."""
    # Fixed values of the data: suffixes of phases and zones.
    zone = "东区|西区|南区|北区|中区|一区|二区|三区|四区|五区|六区|七区|八区|九区|十区|[一二三四五六七八九十0-9]+期"

    def peeled(name: Column) -> Column:
        shorter = trim_all(F.regexp_replace(F.regexp_replace(name, f"[（(](?:{zone})[）)]$", ""), f"(?:{zone})$", ""))
        return F.transform(F.array(shorter), lambda s: F.when(F.length(s) >= 2, s).otherwise(name))

    # each name is held once, as an expression that repeats the one before would grow as a power of the steps
    return F.array_distinct(F.aggregate(F.sequence(F.lit(1), F.lit(3)), F.array(trim_all(c)), lambda names, _: F.concat(names, peeled(F.element_at(names, -1)))))


def html_text(c: Column) -> Column:
    """Text of a page: scripts, styles and tags dropped, the common references decoded, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]+>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def title_of(c: Column) -> Column:
    return first_match(c, r"(?i)<title>([^<]+)</title>")


def url_host(c: Column) -> Column:
    return F.lower(first_match(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)"))


def host_below(c: Column, suffix: str) -> Column:
    """Whether the host is a proper subdomain of suffix; a bad URL is not."""
    return F.coalesce(url_host(c).endswith(f".{suffix}"), F.lit(False))


def excerpt(c: Column, size: int = 150) -> Column:
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size), F.lit("..."))).otherwise(flat)


def hashtags(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"#([^\s#]+)"), F.lit(1)))


def count_text(c: Column) -> Column:
    """A count such as 1.2万 or 3w as a number."""
    number = F.regexp_extract(c, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return F.when(c.rlike("[wW万]"), F.floor(number * 10000 + 0.5).cast("double")).otherwise(number)


def percent(part: Column, whole: Column) -> Column:
    """One decimal, halves up; 0 of nothing."""
    return F.when(whole > 0, F.floor(part / whole * 1000 + 0.5) / 10).otherwise(F.lit(0.0))


def similarity(a: Column, b: Column, chars_a: Column | None = None, chars_b: Column | None = None) -> Column:
    """1 if equal, 0 if one is empty, the length ratio if one contains the other, else shared over most distinct characters (given, or found here)."""
    chars_a, chars_b = (F.array_distinct(F.split(x, "")) if chars is None else chars for x, chars in ((a, chars_a), (b, chars_b)))
    shared = F.size(F.array_intersect(chars_a, chars_b)) / F.greatest(F.size(chars_a), F.size(chars_b))
    ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).when(a.contains(b) | b.contains(a), ratio).otherwise(shared)


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition, for which Spark has no expression."""
    return texts.str.normalize("NFKC")


@F.pandas_udf(StringType())
def decode_references(texts: pd.Series) -> pd.Series:
    """All character references, numeric ones included."""
    import html

    return texts.map(html.unescape, na_action="ignore")


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def table_grid(pages: pd.Series) -> pd.Series:
    """The first table of each page as rows of cells, row and column spans filled in."""
    import html
    import re

    def grid(page: str | None) -> list[list[str]]:
        rows: list[list[str]] = []
        open_cells: dict[int, tuple[int, str]] = {}
        found = re.search(r"(?is)<table\b.*?</table>", page or "")
        for row in re.findall(r"(?is)<tr\b[^>]*>(.*?)</tr>", found[0] if found else ""):
            cells: list[str] = []

            def fill() -> None:
                while len(cells) in open_cells:
                    left, text = open_cells.pop(len(cells))
                    if left > 1:
                        open_cells[len(cells)] = (left - 1, text)
                    cells.append(text)

            later: dict[int, tuple[int, str]] = {}
            for attributes, body in re.findall(r"(?is)<t[dh]\b([^>]*)>(.*?)</t[dh]>", row):
                text = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"(?i)<br\s*/?>|</(?:p|div|li)>", " ", body))).split())
                down, across = (int(m[1]) if (m := re.search(rf'(?i){n}\s*=\s*"?(\d+)', attributes)) else 1 for n in ("rowspan", "colspan"))
                fill()
                for _ in range(across):
                    if down > 1:
                        later[len(cells)] = (down - 1, text)
                    cells.append(text)
            fill()
            open_cells = {**open_cells, **later}
            rows.append(cells)
        return rows

    return pages.map(grid)


# --- names, addresses, links and JSON values of the pipelines -----------------------------------
# Fixed values of the data: the steps by which source_key, poi_key, address_key, feeder_key and campus_key shorten names.


def _chain(c: Column, *steps: tuple[str, str]) -> Column:
    return trim_all(reduce(lambda x, step: F.regexp_replace(x, *step), steps, c))


def source_key(c: Column) -> Column:
    """A source's school name in compatibility form, campus brackets unwrapped, without dots, spaces and dashes."""
    return _chain(nfkc(c), (r"(?U)[·•・\s]", ""), (r"[()（）]([^()（）]*校区)[()（）]", "$1"), ("校区", ""), (r"[()（）\-—_]", ""))


def poi_key(c: Column) -> Column:
    """A school's name without the words that many schools share, for scoring points of interest."""
    return _chain(c, (r"(?U)[\s　]+", ""), ("[（）()]", ""), ("^上海市", ""), ("区", ""), ("学校名称", ""), ("学校|小学|中学|实验|附属|校区|总部|分部|公办|民办", ""))


def address_key(c: Column) -> Column:
    return _chain(F.coalesce(c, F.lit("")), (r"(?U)[\s　]+", ""), ("[（）()].*?[（）()]", ""), ("^上海市", ""), ("^[^区]+区", ""))


def feeder_key(c: Column) -> Column:
    """The name by which a feeder school is looked up."""
    return _chain(c, ("^上海市(徐汇区)?", ""), ("（部分）", ""), ("[（）()]", ""), ("小学|校区", ""))


def campus_key(c: Column) -> Column:
    return _chain(c, (r"(?U)\s+", ""), ("^[-—/]+$", ""), ("^(无|本部|总部|总校区?)$", ""), ("校区$", ""))


def bare_district(c: Column) -> Column:
    """A district without its last 区, 县 or 市; null if blank."""
    return F.nullif(trim_all(F.regexp_replace(c, "[区县市]$", "")), F.lit(""))


def district_in_label(c: Column) -> Column:
    return bare_district(first_match(c, "上海([^区县市]+[区县市])"))


def storage_names(districts: tuple[str, ...] = SCOPE_DISTRICTS) -> list[str]:
    """All spellings under which the districts may be stored."""
    return [name for d in districts for name in ((d, f"{d}区", f"{d}新区") if d == "浦东" else (d, f"{d}区"))]


def search_in(text: str, *columns: Column) -> Column:
    """Whether the columns together, nulls skipped, hold a text, case aside."""
    return F.lower(F.concat_ws(" ", *columns)).contains(text.lower())


def like_literal(text: str) -> str:
    """A LIKE pattern for exactly this text: its wildcards are escaped."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def quoted_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def price_number(c: Column) -> Column:
    """A price with thousands separators as a number above zero, else null."""
    number = F.regexp_replace(c, ",", "").try_cast("double")
    return F.when(number > 0, number)


def _without_dots(path: Column) -> Column:
    """A path with its . and .. segments taken out."""
    segments = F.split(path, "/", -1)
    last = F.element_at(segments, -1)

    def step(kept: Column, x: Column) -> Column:
        up = F.when(F.size(kept) > 1, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)  # the empty one before the first slash stays
        return F.when(x == "..", up).when(x == ".", kept).otherwise(F.array_append(kept, x))

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    return F.array_join(F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept), "/")


def absolute_link(link: Column, base: str | Column) -> Column:
    """A link resolved against the URL of its page: whole links, other hosts, absolute and relative paths, queries and fragments alone."""
    page = F.lit(base) if isinstance(base, str) else base
    scheme, host = F.regexp_extract(page, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), F.regexp_extract(page, r"^[^:/?#]+:(//[^/?#]*)", 1)
    path, query = F.regexp_extract(page, r"^[^:/?#]+:(?://[^/?#]*)?([^?#]*)", 1), F.regexp_extract(page, r"^[^?#]*(\?[^#]*)", 1)
    own, rest = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    beside = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "[^/]*$", ""))
    return (
        F.when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, link))
        .when(own == "", F.concat(scheme, host, F.when(path == "", F.lit("/")).otherwise(path), F.when(rest.startswith("?"), rest).otherwise(F.concat(query, rest))))
        .otherwise(F.concat(scheme, host, _without_dots(F.when(own.startswith("/"), own).otherwise(F.concat(beside, own))), rest))
    )


def listing_link(link: Column, host: str, old: str, city: str) -> Column:
    """A listing's link on its own host by https, with the city and without the parameters that mark where it was found."""
    whole = F.regexp_replace(F.regexp_replace(absolute_link(link, f"https://{host}"), "^http:", "https:"), f"^https://{old}(?=[/?#]|$)", f"https://{host}")
    path, query = F.regexp_replace(whole, r"\?.*$", ""), F.regexp_extract(whole, r"\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(flag|proptype|city)="))
    return F.concat(path, F.lit("?"), F.concat_ws("&", F.concat(kept, F.array(F.lit(f"city={city}")))))


def lines_of(c: Column) -> Column:
    """Text of a cell or article: breaks and paragraph ends as line feeds, tags dropped, references decoded."""
    broken = F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>|</p>", "\n"), r"(?s)<[^>]+>", "")
    return trim_all(F.regexp_replace(decode_references(broken), r"[ \t 　]+", " "))


def article_title(c: Column) -> Column:
    meta = first_match(c, r"(?i)<meta\s+name=[\"']ArticleTitle[\"']\s+content=[\"']([^\"']+)[\"']")
    return F.regexp_replace(lines_of(F.coalesce(meta, F.regexp_extract(c, r"(?is)<title>(.*?)</title>", 1))), "_上海市人民政府$", "")


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def flat_values(c: Column) -> Column:
    """The texts of a JSON object, those in lists too, joined by ；; null if it is no object."""
    def texts(v: Column) -> Column:
        many = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
        return F.transform(F.filter(many, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))

    values = F.map_values(F.from_json(c, "map<string,variant>"))
    return F.when(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.concat_ws("；", F.flatten(F.transform(values, texts))))


def summary(c: Column, size: int = 150) -> Column:
    """An excerpt of prose, or of the values of a JSON object."""
    return excerpt(F.coalesce(flat_values(c), c), size)


def display_value(c: Column) -> Column:
    """A JSON value as it is shown: text, numbers and booleans as they are, of objects the value, name, label or text."""
    kind = F.schema_of_variant(F.try_parse_json(c))
    inner = F.coalesce(*[F.get_json_object(c, f"$.{k}") for k in ("value", "name", "label", "text")])
    return F.when(kind.startswith("OBJECT"), inner).when(kind.startswith("ARRAY") | (kind == "VOID"), F.lit(None)).when(kind == "STRING", F.from_json(F.concat(F.lit('{"v":'), c, F.lit("}")), "v string")["v"]).otherwise(c)


def aliases_of(name: Column, *others: Column) -> Column:
    """Distinct non-blank other names, without the name itself."""
    return F.array_except(F.array_distinct(F.filter(F.concat(*others), lambda x: x.isNotNull() & (x != ""))), F.array(name))


def size_or(first: Column, second: Column) -> Column:
    """The size of the first list that has elements; nulls are empty."""
    sizes = [F.size(F.coalesce(x, F.array().cast("array<string>"))) for x in (first, second)]
    return F.when(sizes[0] > 0, sizes[0]).otherwise(sizes[1])


def bytes_text(c: Column) -> Column:
    """A size as it is shown: bytes below 1024, else KB to TB, with a decimal below ten; a dash for null."""
    out = F.concat(c.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        value = c / F.lit(float(1024**power))
        shown = F.when(value >= 10, F.format_string("%.0f", F.floor(value + 0.5).cast("double"))).otherwise(F.format_string("%.1f", F.floor(value * 10 + 0.5) / 10))
        out = F.when(value >= 1, F.concat(shown, F.lit(f" {unit}"))).otherwise(out)
    return F.coalesce(out, F.lit("—"))


def count_label(c: Column) -> Column:
    """A whole number with thousands separators."""
    return F.format_number(c, 0)


def cell_text(c: Column, label: Column | None = None, size: int = 60) -> Column:
    """A value as a table shows it: a dash for null, a reference with its label in brackets, else cut after ``size`` characters."""
    text = c.cast("string")
    cut = F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("…"))).otherwise(text)
    if label is not None:
        cut = F.when(F.coalesce(label, F.lit("")) != "", F.concat(text, F.lit("（"), label, F.lit("）"))).otherwise(text)
    return F.coalesce(cut, F.lit("—"))
