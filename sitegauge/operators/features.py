"""Page audit: one pass over the HTML column yields every page feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge import constants as K
from sitegauge.functions import html as H
from sitegauge.functions import urls as U

LEVELS = ["h1", "h2", "h3", "h4"]
_FORM = "array<struct<action:string,method:string,input_count:int,has_validation:boolean>>"


def page_features(pages: DataFrame) -> DataFrame:
    """Narrow feature row per crawled page; feature columns are NULL without HTML.

    A map-only job: no shuffle, no Python. ``html`` is not carried on.
    """
    has = lambda tag: f"array_contains(names, '{tag}')"
    count = lambda tag: H.count_of("names", tag)
    cleaned = pages.selectExpr(
        "site", "start_url", "ord", "url", "status_code", "load_time", "error",
        H.strip_hidden("if(html <> '', html, null)") + " as doc")
    lexed = cleaned.selectExpr("*", H.start_tags("doc") + " as tags")
    split = lexed.selectExpr("*", H.tag_names("tags") + " as names").selectExpr(
        "*",
        H.named("tags", "names", "img") + " as imgs",
        H.named("tags", "names", "meta") + " as metas",
        H.named("tags", "names", "link") + " as link_tags",
        H.named("tags", "names", "a") + " as anchors",
        H.title_text("doc") + " as title",
        # passes for headings and forms run only on pages that have such a tag
        f"case when {has('form')} then {H.form_structs('doc')} "
        f"when doc is not null then cast(array() as {_FORM}) end as forms",
        *[f"case when {has(level)} then {H.heading_texts('doc', level)} "
          f"when doc is not null then cast(array() as array<string>) end as {level}"
          for level in LEVELS])
    found = split.selectExpr(
        "*", f"transform(metas, t -> {H.attribute('t', 'name')}) as meta_names", _hrefs() + " as hrefs")
    resolved = found.select(
        "*", F.expr(_meta_description()).alias("meta_description"),
        U.resolve_all("hrefs", "start_url").alias("urls"))
    when_html = lambda text: f"if(doc is not null, {text}, null)"
    headings = ", ".join(f"'{level}', {level}" for level in LEVELS)
    return resolved.select(
        "site", "start_url", "ord", "url", "status_code", "load_time", "error",
        F.expr("doc is not null").alias("has_html"),
        U.module_of("url").alias("module"),
        U.depth(F.col("url")).alias("depth"),
        "title", "meta_description",
        F.expr(when_html(f"map({headings})")).alias("headings"),
        F.expr("size(imgs)").alias("img_total"),
        F.expr("size(filter(imgs, t -> "
               f"{H.strip_space(H.attribute_or_empty('t', 'alt'))} = ''))").alias("img_missing_alt"),
        "forms",
        F.expr("size(forms)").alias("form_count"),
        F.expr(count("button")).alias("button_count"),
        F.expr("exists(link_tags, t -> array_contains(split("
               rf"{H.attribute_or_empty('t', 'rel')}, r'\s+'), 'canonical'))").alias("has_canonical"),
        F.expr("array_position(meta_names, 'viewport') > 0").alias("has_viewport"),
        F.expr(f"exists(metas, t -> {H.attribute('t', 'property')} <=> 'og:title')").alias("has_og"),
        F.expr("title <> ''").alias("has_title"),
        F.expr("meta_description <> ''").alias("has_meta_description"),
        F.expr(count("h1")).alias("h1_count"),
        F.expr("size(names)").alias("element_count"),
        F.expr(count("script")).alias("scripts"),
        _links().alias("links"))


def _meta_description() -> str:
    """Content of the first description tag, else of the first alternative, else ''."""
    first = lambda name: f"get(metas, cast(array_position(meta_names, '{name}') as int) - 1)"
    tag = f"coalesce({first('description')}, {first('meta-description')})"
    return f"if(doc is not null, {H.attribute_or_empty(tag, 'content')}, null)"


def _hrefs() -> str:
    """Trimmed link targets of a page in document order, without in-page and mail links."""
    values = (f"transform(anchors, t -> regexp_replace("
              rf"{H.strip_space(H.attribute('t', 'href'))}, r'[\t\r\n]', ''))")
    skipped = " or ".join(f"startswith(h, '{p}')" for p in K.SKIPPED_HREF_PREFIXES)
    return f"filter({values}, h -> h is not null and not ({skipped}))"


def _links() -> Column:
    """http(s) links of a page with the test whether they stay on the site."""
    return F.transform("urls", lambda u: F.struct(
        u.alias("dst_url"),
        U.is_same_domain(u, U.base_domain(F.col("start_url"))).alias("is_internal")))


# The outer explodes below keep Spark from adding a size filter under the feature
# columns, which would run the whole page audit a second time on unstaged features.


def page_headings(features: DataFrame) -> DataFrame:
    """One row per heading text."""
    return (features
            .select("site", "url", F.explode_outer("headings").alias("level", "texts"))
            .select("site", "url", "level", F.posexplode("texts").alias("pos", "text")))


def page_forms(features: DataFrame) -> DataFrame:
    """One row per form."""
    return (features
            .select("site", "url", F.posexplode_outer("forms").alias("form_no", "form"))
            .where(F.col("form_no").isNotNull())
            .select("site", "url", "form_no", "form.*"))
