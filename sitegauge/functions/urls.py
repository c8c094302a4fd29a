"""URL columns: cleaning, parts, module, depth, resolution, domain tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegauge import constants as K

_SCHEME = r"[a-zA-Z][a-zA-Z0-9+.\-]*"
_PATH = rf"^(?:{_SCHEME}:)?(?://[^/?#]*)?([^?#]*)"
_HOST = rf"^(?:{_SCHEME}:)?//([^/?#]*)"
_TARGET = rf"^(?:{_SCHEME}:)?(?://[^/?#]*)?(.*)$"


def clean_url(url: Column) -> Column:
    """The URL without fragment and query."""
    return F.regexp_replace(url, r"(?s)[#?].*$", "")


def host(url: Column) -> Column:
    """Network location (user, host and port), '' when there is none."""
    return F.regexp_extract(url, _HOST, 1)


def path(url: Column) -> Column:
    """Path without the parameters of the last segment."""
    return F.regexp_replace(F.regexp_extract(url, _PATH, 1), r";[^/]*$", "")


def request_target(url: Column) -> Column:
    """Everything after the host, '/' when nothing is left; robots rules test this."""
    rest = F.regexp_extract(url, "(?s)" + _TARGET, 1)
    return F.when(rest == "", F.lit("/")).otherwise(rest)


def base_domain(start_url: Column) -> Column:
    return F.replace(host(start_url), F.lit("www."), F.lit(""))


def is_same_domain(url: Column, domain: Column) -> Column:
    """True when the host is the base domain or one of its subdomains."""
    name = base_domain(url)
    return (name == domain) | F.endswith(name, F.concat(F.lit("."), domain))


def depth(url: Column) -> Column:
    """Number of non-empty path segments."""
    return F.size(F.filter(F.split(path(url), "/"), lambda s: s != ""))


def module_of(url: str) -> Column:
    """Site section of the URL in column ``url``, from the first path segment.

    The segment is bound once as ``s``; a segment outside the lookup is shown with
    the first letter of every run of letters in upper case.
    """
    segment = (rf"lower(substring_index(regexp_replace(regexp_replace(regexp_extract("
               rf"{url}, r'{_PATH}', 1), r';[^/]*$', ''), r'^/+|/+$', ''), '/', 1))")
    cases = " ".join(f"when contains(s, '{key}') then '{name}'" for key, name in K.MODULE_KEYS)
    letters = r"\p{Lu}\p{Ll}\p{Lt}"
    runs = f"regexp_extract_all(translate(s, '-_', '  '), r'[{letters}]+|[^{letters}]+', 0)"
    title = f"array_join(transform({runs}, r -> concat(upper(left(r, 1)), substr(r, 2))), '')"
    return F.expr(f"element_at(transform(array({segment}), s -> "
                  f"case when s = '' then '{K.HOMEPAGE}' {cases} else {title} end), 1)")


def seed_url(raw: Column) -> Column:
    """Struct(is_valid, url, error) of a user-typed start URL."""
    text = F.regexp_replace(raw, r"^\s+|\s+$", "")
    url = F.when(text.startswith("http://") | text.startswith("https://"), text).otherwise(
        F.concat(F.lit("https://"), text))
    name = host(url)
    unbalanced = F.contains(name, F.lit("[")) != F.contains(name, F.lit("]"))
    error = (F.when(unbalanced, F.lit(K.UNPARSABLE_MESSAGE))
             .when(name == "", F.lit(K.NO_DOMAIN_MESSAGE))
             .otherwise(F.lit("")))
    return F.struct((error == "").alias("is_valid"), url.alias("url"), error.alias("error"))


_FULL_URL = r"""
    case
      when x.href = '' then b.url
      when x.scheme <> '' and x.scheme <> b.scheme
        then x.href
      when startswith(x.rest, '//') then concat(b.scheme, ':', x.path, x.params, x.tail)
      when x.path = '' and x.params = ''
        then concat(b.origin, b.path, if(startswith(x.tail, '?'), '', b.query), x.tail)
      else concat(b.origin, element_at(transform(
        array(if(startswith(x.path, '/'), x.path,
                 regexp_replace(concat(b.folder, x.path), r'/{{2,}}', '/'))),
        p -> if(rlike(p, r'(^|/)\.\.?(/|$)'), {undotted}, p)), 1), x.params, x.tail)
    end"""

# '.' and '..' segments of the absolute path p resolved
_UNDOTTED = """
    element_at(transform(array(array_join(concat(
      aggregate(split(p, '/'), cast(array() as array<string>),
        (kept, s) -> case when s = '..' then slice(kept, 1, greatest(size(kept) - 1, 0))
                          when s = '.' then kept else concat(kept, array(s)) end),
      if(element_at(split(p, '/'), -1) in ('.', '..'), array(''), cast(array() as array<string>))),
      '/')), j -> if(startswith(j, '/'), j, concat('/', j))), 1)"""


def resolve_all(hrefs: str, base: str) -> Column:
    """Absolute http(s) URLs of the trimmed hrefs in array column ``hrefs``, in order.

    They are resolved against column ``base``. Every step binds its parts in an array
    of structs, so no part is computed twice: ``b`` the base URL, ``x`` one href. A
    scheme equal to the base's, without a host, makes a relative reference; an empty
    query or fragment is dropped; a path relative to the folder loses doubled slashes.
    """
    scheme = lambda x: f"lower(regexp_extract({x}, r'^({_SCHEME}):', 1))"
    base_path = f"regexp_extract({base}, r'{_PATH}', 1)"
    site = rf"""array(named_struct(
        'url', {base}, 'scheme', {scheme(base)},
        'origin', concat({scheme(base)}, '://', regexp_extract({base}, r'{_HOST}', 1)),
        'path', {base_path},
        'folder', concat('/', regexp_replace({base_path}, r'^/|[^/]*$', '')),
        'query', regexp_extract({base}, r'(?s)^[^?#]*(\?[^#]*)', 1)))"""
    with_scheme = f"transform({hrefs}, h -> named_struct('href', h, 'scheme', {scheme('h')}))"
    with_rest = f"""transform({with_scheme}, x -> named_struct(
        'href', x.href, 'scheme', x.scheme, 'rest', if(x.scheme <> '' and x.scheme = b.scheme,
          regexp_replace(x.href, r'^{_SCHEME}:', ''), x.href)))"""
    with_parts = rf"""transform({with_rest}, x -> named_struct(
        'href', x.href, 'scheme', x.scheme, 'rest', x.rest,
        'path', regexp_extract(x.rest, r'^((?:[^?#]*/)?[^/;?#]*)', 1),
        'params', regexp_replace(
          regexp_extract(x.rest, r'^(?:[^?#]*/)?+[^/;?#]*+(;[^/?#]*)', 1), '^;$', ''),
        'tail', regexp_replace(regexp_extract(x.rest, r'(?s)^[^?#]*(.*)$', 1),
                               r'^\?(#|$)|#$', '$1')))"""
    full = _FULL_URL.format(undotted=_UNDOTTED)
    return F.expr(f"filter(flatten(transform({site}, b -> transform({with_parts}, x -> {full}))), "
                  "u -> rlike(u, '^(?i:https?):'))")
