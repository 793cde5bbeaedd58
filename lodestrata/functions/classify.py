"""Classifications of names and titles as ordered conditional expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions.text import bracket_cut, trim_all

# Fixed values of the data: the patterns by which titles and names are told apart.
TITLE_PATTERNS = (
    (r"公办小学.*(划片|对口|范围)|小学.*(划片|对口范围|学区划分)|幼升小.*对口|一年级新生招生范围", "primary-scope"),
    (r"公办初中.*(入学方式|对口|范围)|初中.*(对口|划区|学区划分|地段公示)|小升初.*对口|小学对口公办初中方案", "middle-scope"),
    (r"招生方案（学校层面）.*(初中|中学|九年|一贯制)|(初中|中学|九年|一贯制).*招生方案（学校层面）", "middle-scope"),
    (r"招生方案（学校层面）", "primary-scope"),
    (r"校区范围|招生划片|招生地段公示|办学基本情况.*对口范围", "primary-scope"),
    (r"实施意见|实施方案|招生入学工作", "district-policy"),
    (r"学校一览|招生学校|登记点|验证点", "school-list"),
    (r"考试中心|门户|专栏|服务网站", "service"),
)
MODE_WORDS = (("直升", "direct"), ("派位", "placement"), ("部分对口", "partial"), ("对口", "assign"))
PLACEHOLDER = r"^(统筹安排|统筹|待定|待安排|其他|合计|总计|无)$"
NOT_RESIDENTIAL = r"小学|中学|学校|幼儿园|培训|居委|社区|街道|村民|村委|委员会|片区|地区|镇$|筹|部队|集体户口"
NOT_AREA = r"小学|中学|学校|幼儿园|培训|委员会|片区|地区|全区招生|开发区|旅游区|筹|部队|集体户口"
ROAD_PREFIX = r"^(清河路|城中路|城东路|城南路|城北路|道路)"
RESIDENTIAL_END = r"(小区|公寓|花园|家园|苑|坊|里|城|府|湾|邸|庭)$"
VILLAGE_END = r"(?:新村|[一二三四五六七八九十百]+村)$"
AREA_END = r"(社区|居委会|居委|村民小组|中心村|新村|村)$"
STATUSES = ("missing", "source-found", "boundary-text", "partially-linked", "linked")


def first_of(c: Column, patterns: Sequence[tuple[str, str]], other: str) -> Column:
    """The label of the first pattern that a text matches."""
    out = F.lit(other)
    for pattern, label in reversed(patterns):
        out = F.when(c.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def title_category(c: Column) -> Column:
    return first_of(c, TITLE_PATTERNS, "other")


def has_scope(category: Column) -> Column:
    return category.isin("primary-scope", "middle-scope")


def admission_mode(c: Column) -> Column:
    return first_of(c, MODE_WORDS, "unknown")


def is_placeholder(key: Column) -> Column:
    return key.rlike(PLACEHOLDER)


def is_residential(c: Column) -> Column:
    """Whether a name is certainly a housing estate's."""
    name = trim_all(c)
    barred = name.rlike(NOT_RESIDENTIAL) | name.rlike("[一二三四五六七八九十百]+居$") | name.rlike(ROAD_PREFIX) | name.rlike("[路街公号弄]")
    return (F.length(name) >= 4) & ~barred & (name.rlike(RESIDENTIAL_END) | name.rlike(VILLAGE_END))


def is_official_area(c: Column) -> Column:
    """Whether a name is certainly an enrolment area's, housing estates included."""
    name = trim_all(c)
    barred = name.rlike(NOT_AREA) | name.rlike(r"(路|街|公路)\d+弄") | name.rlike(ROAD_PREFIX) | name.rlike(r"[路街公]\d*(号|弄)$|^\d+(号|弄)$")
    return (F.length(name) >= 3) & ~barred & (name.rlike(AREA_END) | name.rlike(RESIDENTIAL_END))


def audit_status(total: Column, linked: Column, boundary: Column, sources: Column) -> Column:
    """All linked, some linked, boundary text, a source with scope, or nothing."""
    return (
        F.when((total > 0) & (linked >= total), "linked").when(linked > 0, "partially-linked")
        .when(boundary > 0, "boundary-text").when(sources > 0, "source-found").otherwise("missing")
    )


def rank_of(c: Column, order: Sequence[str]) -> Column:
    """The place of a value in an order; others come last."""
    out = F.lit(len(order))
    for n, value in reversed(list(enumerate(order))):
        out = F.when(c == value, n).otherwise(out)
    return out


def merge_key(c: Column) -> Column:
    """The name by which duplicates of an entity meet; null if nothing is left."""
    return F.nullif(bracket_cut(c), F.lit(""))
