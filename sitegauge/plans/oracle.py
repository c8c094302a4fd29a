"""SQL twins of the registered queries, for DuckDB over the given tables.

Written as plain SQL over the raw tables, independent of the DataFrame code; only
the fixed texts are shared.
"""

from __future__ import annotations

import re

from sitegauge import constants as K
from sitegauge.sources.derived import DRAWN_DEPTH, DRAWN_TREES, SECTIONS, STATUS_CYCLE


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in values) + ")"


def path_of(x: str) -> str:
    return (f"case when {x} < 100 and {x} % 20 = 0 then '' "
            f"else {sql_list(SECTIONS)}[({x} % 14 + 1)::int] || '/' || ({x})::varchar end")


def module_sql(url: str) -> str:
    path = f"regexp_extract({url}, '^https?://[^/?#]*([^?#]*)', 1)"
    first = f"lower(split_part(trim({path}, '/'), '/', 1))"
    cases = " ".join(f"when contains({first}, {q(k)}) then {q(m)}" for k, m in K.MODULE_KEYS)
    words = f"replace(replace({first}, '-', ' '), '_', ' ')"
    letters = r"\p{Lu}\p{Ll}\p{Lt}"
    return (f"case when trim({path}, '/') = '' then 'Homepage' {cases} else "
            f"array_to_string(list_transform(regexp_extract_all({words}, "
            f"'[{letters}]+|[^{letters}]+'), lambda w: upper(w[1]) || w[2:]), '') end")


def even(x: str, digits: int) -> str:
    return f"(round_even(({x})::double * {10 ** digits}, 0)::double / {10 ** digits})"


def shown(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', ({x})::double)"


def tags(name: str, doc: str = "doc") -> str:
    return f"regexp_extract_all({doc}, '(?i)<{name}(?:[\\s/][^>]*)?>')"


def decoded(x: str) -> str:
    for reference, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                            ("&apos;", "'"), ("&amp;", "&")):
        x = f"replace({x}, {q(reference)}, {q(char)})"
    return x


def text_sql(x: str) -> str:
    return decoded(f"trim(regexp_replace({x}, '<[^>]*>', '', 'g'))")


_STATUS = " ".join(
    f"when severity = {q(s)} then {sql_list(slots)}[slot]" for s, slots in K.STATUS_SLOTS.items())
_SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_NEAR = "page_id - page_id % 20 + (page_id % 20 * 3 + 1) % 20"
_FAR = ("(page_id - page_id % 20) % 100 + (page_id // 100 * 2 + page_id % 2) * 100 "
        "+ (page_id % 20 * 7 + 2) % 20")


def rule(cond, no, issue, severity, hours, description, source, occurrences="1"):
    return (f"select site, 0 as phase, ord as pos, {no} as rule_no, 0 as form_no, url as page_url, "
            f"module, {q(issue)} as issue_type, {severity} as severity, "
            f"({occurrences})::bigint as occurrences, ({hours})::double as fix_time_hours, "
            f"{description} as description, {q(source)} as source from feats where {cond}")


def _page_rules() -> str:
    page = lambda *tail: "'Page ''' || url || ''' ' || " + " || ".join(tail)
    load = "coalesce(load_time, 0)"
    low, medium, high = q("Low"), q("Medium"), q("High")
    return " union all ".join([
        rule("status_code in (404, 410)", 1, "Broken Link (404)", high, 0.5,
             page("'returns HTTP '", "status_code::varchar", "' — broken or removed.'"), "crawl_status"),
        rule("status_code in (500, 502, 503)", 2, "Server Error", high, 2.0,
             page("'returns server error '", "status_code::varchar", "'.'"), "crawl_status"),
        rule("error = 'timeout'", 3, "Page Timeout", high, 3.0, page("'timed out after 10s.'"),
             "crawl_timeout"),
        rule(f"{load} > 3", 4, "Slow Page Load", "case when load_time > 6 then 'High' else 'Medium' end",
             4.0, page("'loaded in '", "load_time::varchar", "'s (threshold: 3s).'"), "crawl_performance"),
        rule(f"{load} > 1.5 and {load} <= 3", 5, "Moderate Load Time", low, 2.0,
             page("'loaded in '", "load_time::varchar", "'s — consider optimization.'"),
             "crawl_performance"),
        rule("has_html and title = ''", 6, "Missing Page Title", medium, 0.25,
             page("'has no <title> tag — impacts SEO.'"), "crawl_seo"),
        rule("has_html and meta_description = ''", 7, "Missing Meta Description", low, 0.25,
             page("'missing meta description.'"), "crawl_seo"),
        rule("h1_count > 1", 8, "Multiple H1 Tags", low, 0.5,
             page("'has '", "h1_count::varchar", "' H1 tags; only one recommended.'"), "crawl_seo",
             "h1_count"),
        rule("has_html and h1_count = 0", 9, "Missing H1 Tag", medium, 0.5,
             page("'has no H1 heading — impacts accessibility/SEO.'"), "crawl_accessibility"),
        rule("img_missing_alt > 0", 10, "Missing Image Alt Text",
             "case when img_missing_alt > 5 then 'Medium' else 'Low' end", "img_missing_alt / 10",
             "img_missing_alt::varchar || '/' || img_total::varchar || ' images on ''' || url || "
             "''' lack alt text (WCAG 2.1 violation).'", "crawl_accessibility", "img_missing_alt"),
        "select f.site, 0, p.ord, 11, f.form_no, f.url, p.module, 'Form Without Client-Side Validation', "
        "'High', 1, 2.0, 'Form on ''' || f.url || ''' (action=''' || action || ''') has ' || "
        "input_count::varchar || ' inputs with no validation.', 'crawl_forms' "
        "from forms f join feats p on f.site = p.site and f.url = p.url "
        "where input_count > 0 and not has_validation",
        rule("not has_viewport", 12, "Missing Viewport Meta Tag", medium, 0.25,
             page("'missing viewport meta — not mobile-responsive.'"), "crawl_mobile"),
        rule("not has_canonical and depth > 0", 13, "Missing Canonical Tag", low, 0.25,
             page("'missing canonical tag — duplicate content risk.'"), "crawl_seo"),
        rule("not has_og", 14, "Missing Open Graph Tags", low, 0.5,
             page("'has no Open Graph tags — poor social sharing.'"), "crawl_seo"),
    ])


def _rec(seq, values, cond, title):
    priority, category, detail, effort, impact = values
    return (f"select site, {priority} as priority, {seq} as seq, {q(category)} as category, "
            f"{title} as title, {q(detail)} as detail, {q(effort)} as effort, {q(impact)} as impact "
            f"from advice where {cond}")


def _recommendations() -> str:
    rows = [
        _rec(1, K.REC_BROKEN, "issues > 0 and broken > 0", "'Fix ' || broken || ' Broken Link(s)'"),
        _rec(2, K.REC_FORMS, "forms > 0", "'Add Validation to ' || forms || ' Form(s)'"),
        _rec(3, K.REC_SLOW, "slow > 0", "'Optimise ' || slow || ' Slow Page(s) — max ' || "
             + shown("max_load", 1) + " || 's'"),
        _rec(4, K.REC_ALT, "issues > 0 and missing_alts > 0",
             "'Add Alt Text to ' || missing_alts || ' Image(s) — WCAG 2.1'"),
        _rec(5, K.REC_TITLES, "no_title + no_meta > 0",
             "'Fix ' || no_title || ' Missing Titles & ' || no_meta || ' Meta Descriptions'"),
        _rec(6, K.REC_VIEWPORT, "no_viewport > 0", "'Add Viewport Meta to ' || no_viewport || ' Page(s)'"),
        _rec(7, K.REC_SERVER, "server > 0", "'Resolve ' || server || ' Server Error(s) (5xx)'"),
        _rec(8, K.REC_CANONICAL, "canonical > 3", "'Add Canonical Tags to ' || canonical || ' Pages'"),
        _rec(9, K.REC_HTTPS, "issues > 0", q(K.REC_HTTPS_TITLE)),
        _rec(10, K.REC_MONITORING, "issues > 0", q(K.REC_MONITORING_TITLE)),
        _rec(1, K.REC_NONE, "issues = 0", q(K.REC_NONE_TITLE)),
    ]
    return " union all ".join(rows)


def _flag(values, cond):
    kind, risk, reason, frequency = map(q, values)
    return (f"select site, {kind} as issue_type, {risk} as risk, {reason} as reason, "
            f"{frequency} as frequency from advice where issues > 0 and {cond}")


def _status_text(value: str, middle: str) -> str:
    return (f"case when {value} >= 70 then {q(K.GOOD)} when {value} >= 40 then {q(middle)} "
            f"else {q(K.POOR)} end")


def _category_table() -> str:
    live = {
        "Issues": "high_issues || ' high-sev issues ÷ ' || pages || ' pages'",
        "Broken Links": "broken || ' broken ÷ ' || pages || ' pages'",
        "Performance": "'avg load ' || " + shown("coalesce(avg_load, 0)", 2) + " || 's'",
        "SEO": "with_title || ' of ' || pages || ' pages have <title>'",
        "Accessibility": "(images - missing_alts) || ' of ' || images || ' images have alt text'",
        "Meta Tags": "with_meta || ' of ' || pages || ' pages have meta desc'",
        "Mobile": "with_viewport || ' of ' || pages || ' pages have viewport tag'",
    }
    rows = []
    for category, icon, weight, checked, formula, good in K.CATEGORY_TEXTS:
        value = f"least(100, {even(_SCORE[category], 1)})"
        rows.append(
            f"select site, {q(icon)} as icon, {q(category)} as category, {q(weight)} as weight, "
            f"{shown(value, 0)} || ' / 100' as your_score, "
            f"{_status_text(value, K.NEEDS_WORK_CATEGORY)} as status, {q(checked)} as what_is_checked, "
            f"{live[category]} || ' → score ' || {shown(value, 0)} as this_site, "
            f"{q(formula)} as formula, {q(good)} as good_score_means from scores")
    return " union all ".join(rows)


_SCORE = {"Issues": "s_issues", "Broken Links": "s_broken", "Performance": "s_perf", "SEO": "s_seo",
          "Accessibility": "s_alt", "Meta Tags": "s_meta", "Mobile": "s_mobile"}
_TOTAL = " + ".join(f"{_SCORE[name]} * {weight}::double" for name, weight in K.HEALTH_WEIGHTS)
_HEALTH = even(f"least(100, greatest(0, {_TOTAL}))", 1)
_COUNTS = {"forms": "Form Without Client-Side Validation", "slow": "Slow Page Load",
           "no_title": "Missing Page Title", "no_meta": "Missing Meta Description",
           "no_viewport": "Missing Viewport Meta Tag", "server": "Server Error",
           "canonical": "Missing Canonical Tag"}


def _visits(condition: str) -> str:
    return f"""
        select * from (
          select site, row_number() over (partition by site order by level, path)::int as visit_no, url,
            level::int as level from walk) where {condition}"""


def _broken(condition: str) -> str:
    return f"""
        select site, dst_clean as url, status::int as status, 'external' as origin,
          row_number() over (partition by site order by dst_clean) as pos
        from checked where {condition} and status in {in_list(K.BROKEN_EXTERNAL_CODES)}
        union all
        select site, url, coalesce(status_code, 0), 'internal', ord from crawl
        where status_code in {in_list(K.BROKEN_INTERNAL_CODES)} or error <> ''"""


def _ctes() -> dict[str, str]:
    return {
        "crawl": f"""
            select site, 'https://' || site || '.test/' as start_url, page_id as ord,
              'https://' || site || '.test/' || {path_of('page_id')} as url,
              case when failed then null when page_id % 23 = 5 then 404
                   when page_id % 29 = 7 then 500 else 200 end as status_code,
              content_type,
              case when not failed then (page_id * 7919 % 7000)::double / 1000 end as load_time,
              case when page_id % 31 = 3 then 'timeout'
                   when page_id % 37 = 11 then 'connection_error' end as error,
              case when not failed and content_type like '%text/html%' then concat(
                case when page_id % 10 = 3
                       then replace(replace(html, '<h1>', '<h5>'), '</h1>', '</h5>')
                     when page_id % 11 = 4
                       then replace(replace(html, '<title>', '<b>'), '</title>', '</b>')
                     else html end,
                repeat('<img src="a.png">', page_id % 8),
                repeat('<img src="b.png" alt="ok">', page_id % 3),
                case page_id % 5
                  when 0 then '<form action="/f" method="post"><input name="a"></form>'
                  when 1 then '<form action="/g"><input type="email"></form>' else '' end,
                case when page_id % 4 <> 0 then '<meta name="description" content="d">' else '' end,
                case when page_id % 3 <> 0
                  then '<meta name="viewport" content="width=device-width">' else '' end,
                case when page_id % 2 = 0 then '<link rel="canonical" href="/c">' else '' end,
                case when page_id % 6 = 0 then '<meta property="og:title" content="t">' else '' end,
                case when page_id % 9 = 0 then '<h1>second</h1>' else '' end,
                case when page_id % 7 < 3 then concat(
                  '<a href="https://ext-', page_id % 97, '.test/x?y=1">e</a>',
                  '<a href="//ext-', page_id * 3 % 13, '.test/x#top">f</a>') else '' end,
                '<a href="/', {path_of('(' + _NEAR + ')')}, '">n</a>',
                '<a href="/', {path_of('(' + _FAR + ')')}, '">n</a>') end as html
            from (select *, 'site-' || (page_id // 20 % 5) as site,
                    page_id % 31 = 3 or page_id % 37 = 11 as failed,
                    case when page_id % 41 = 9 then 'application/pdf'
                         else 'text/html; charset=utf-8' end as content_type
                  from pages)""",
        "docs": r"""
            select *, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
                '(?is)(<script[^>]*>).*?</script>', '\1', 'g'),
                '(?is)(<style[^>]*>).*?</style>', '\1', 'g') as doc from crawl""",
        "feats": f"""
            select site, start_url, ord, url, status_code, load_time, error,
              doc is not null and doc <> '' as has_html, {module_sql('url')} as module,
              len(list_filter(string_split(regexp_extract(url, '^https?://[^/]*(.*)$', 1), '/'),
                lambda s: s <> ''))::int as depth, doc,
              {text_sql("regexp_extract(doc, '(?is)<title[^>]*>(.*?)</title>', 1)")} as title,
              regexp_extract(doc, '<meta name="description" content="([^"]*)"', 1) as meta_description,
              len({tags('img')})::int as img_total,
              len(list_filter({tags('img')}, lambda t: not contains(t, 'alt="ok"')))::int
                as img_missing_alt,
              len({tags('form')})::int as form_count, len({tags('button')})::int as button_count,
              contains(doc, '<link rel="canonical"') as has_canonical,
              contains(doc, '<meta name="viewport"') as has_viewport,
              contains(doc, '<meta property="og:title"') as has_og,
              len({tags('h1')})::int as h1_count,
              len(regexp_extract_all(doc, '<[a-zA-Z][^>]*>'))::int as element_count,
              len({tags('script')})::int as scripts
            from docs""",
        "headings": " union all ".join(
            f"select site, url, '{h}' as level, unnest(texts) as raw, "
            f"generate_subscripts(texts, 1) - 1 as pos from (select site, url, "
            f"regexp_extract_all(doc, '(?is)<{h}(?:\\s[^>]*)?>(.*?)</{h}>', 1) as texts from feats)"
            for h in ("h1", "h2", "h3", "h4")),
        "forms": """
            select site, url, form_no::int as form_no, regexp_extract(form, 'action="([^"]*)"', 1) as action,
              case when contains(form, 'method="post"') then 'POST' else 'GET' end as method,
              len(regexp_extract_all(form, '<input'))::int as input_count,
              contains(form, 'type="email"') as has_validation
            from (select site, url, unnest(f) as form, generate_subscripts(f, 1) - 1 as form_no
                  from (select site, url, regexp_extract_all(doc, '(?s)<form.*?</form>') as f from feats))""",
        "hrefs": r"""
            select site, start_url, url as src_url, trim(unnest(h)) as href, generate_subscripts(h, 1) - 1 as pos
            from (select *, regexp_extract_all(doc, '<a href="([^"]*)"', 1) as h from feats)""",
        "edges": f"""
            select site, src_url, pos::int as pos, dst_url,
              regexp_replace(dst_url, '[#?].*', '') as dst_clean,
              regexp_matches(dst_url, '^https://' || site || '\\.test(/|$)') as is_internal
            from (select *, case when href like 'http%' then href when href like '//%' then 'https:' || href
                    else start_url || {decoded("regexp_replace(href[2:], '[?]$', '')")} end as dst_url from hrefs)""",
        "ext": "select distinct site, dst_clean from edges where not is_internal",
        "ext_counts": """
            select site, count(*) as total_external_links, count(*) as external_links_checked
            from ext group by site""",
        "checked": f"""
            select site, dst_clean, row_number() over (partition by site order by dst_clean) as nth,
              {sql_list(STATUS_CYCLE)}[regexp_extract(dst_clean, 'ext-(\\d+)', 1)::int % 13 + 1] as status
            from ext""",
        "broken": _broken("true"),
        "broken20": _broken("nth <= 20"),
        "raw": f"""
            select *, 'Open' as status from ({_page_rules()} union all
            select site, case origin when 'external' then 1 else 2 end, pos,
              case when status = 0 then 16 else 15 end, 0, url, {module_sql('url')},
              case when status = 0 then 'Unreachable Link' else 'Broken External Link' end,
              case when status in (0, 404, 410) then 'High' else 'Medium' end, 1, 0.5,
              'Link ''' || url || ''' returned status ' || status || '.', 'crawl_links' from broken)""",
        "dedup": f"""
            select * exclude (rn, total, occurrences, status, slot), total::bigint as occurrences,
              case {_STATUS} end as status
            from (select *, sum(occurrences) over (partition by site, module, issue_type) as total,
                    row_number() over (partition by site, module, issue_type
                      order by phase, pos, rule_no, form_no) as rn,
                    (strpos('0123456789abcdef', substr(md5(site || '|' || module || '|' || issue_type), 1, 1))
                      - 1) % 4 + 1 as slot from raw)
            where rn = 1""",
        "iss": """
            select *, case severity when 'High' then 3.0 when 'Medium' then 2.0 else 1.0 end::double
                as severity_weight, (severity = 'High')::int as is_critical,
              (status = 'Reopened')::int as is_recurring, (status in ('Open', 'Reopened'))::int as is_open
            from dedup""",
        "totals": """
            select p.*, coalesce(b.broken, 0) as broken, coalesce(i.issues, 0) as issues,
              coalesce(i.high_issues, 0)::bigint as high_issues
            from (select site, min(start_url) as start_url, count(*) as pages,
                    count(*) filter (title <> '') as with_title,
                    count(*) filter (meta_description <> '') as with_meta,
                    count(*) filter (has_viewport) as with_viewport,
                    coalesce(sum(img_total), 0)::bigint as images,
                    coalesce(sum(img_missing_alt), 0)::bigint as missing_alts,
                    sum(load_time::decimal(18, 3)) filter (load_time > 0)::double
                      / nullif(count(*) filter (load_time > 0), 0) as avg_load,
                    max(load_time) as max_load from feats group by site) p
            left join (select site, count(*) as broken from broken group by site) b using (site)
            left join (select site, count(*) as issues, sum(is_critical) as high_issues
                       from iss group by site) i using (site)""",
        "scores": """
            select *, greatest(0, 100 - high_issues / pages * 50) as s_issues,
              greatest(0, 100 - broken / pages * 200) as s_broken,
              greatest(0, 100 - (coalesce(avg_load, 0) - 1) * 15) as s_perf,
              with_title / pages * 100 as s_seo,
              case when images = 0 then 100 else greatest(0, (1 - missing_alts / images) * 100) end as s_alt,
              with_meta / pages * 100 as s_meta, with_viewport / pages * 100 as s_mobile from totals""",
        "risk": f"""
            select site, module, issue_count, open_issues, high_severity,
              {even('avg_weight', 2)} as avg_severity_weight, {even('rate', 3)} as broken_link_rate,
              raw_risk_score, issue_count < 5 as small_sample, risk_score,
              case when risk_score >= 70 then 'High' when risk_score >= 40 then 'Medium' else 'Low' end
                as risk_level
            from (select *, case when hi > lo then {even('(raw_risk_score - lo) / (hi - lo) * 100', 1)}
                    else 50 end as risk_score
              from (select *, min(raw_risk_score) over (partition by site) as lo,
                      max(raw_risk_score) over (partition by site) as hi
                from (select *, issue_count * 0.4::double + avg_weight * 10 * 0.35::double
                        + rate * 100 * 0.25::double as raw_risk_score
                  from (select i.*, coalesce(b.n, 0) / greatest(coalesce(p.n, 1), 1) as rate
                    from (select site, module, count(*) as issue_count, sum(is_open)::bigint as open_issues,
                            sum(is_critical)::bigint as high_severity,
                            sum(severity_weight) / count(*) as avg_weight
                          from iss group by site, module) i
                    left join (select site, module, count(*) as n from feats group by all) p
                      using (site, module)
                    left join (select site, {module_sql('url')} as module, count(*) as n
                               from broken group by all) b using (site, module)))))""",
        "runs": """
            select site, start_url, case when site <> 'site-4' then
                round(sum(load_time::decimal(18,3)), 2)::double end as crawl_seconds,
              case when site <> 'site-4' then site <> 'site-3' end as respect_robots
            from crawl group by site, start_url
            union all select distinct site || '-private', start_url || 'privacy', 0.25, true from crawl
            union all select distinct site || '-ignoring', start_url || 'privacy', 0.5, false from crawl
            union all select distinct site || '-nowhere', 'https:///nowhere', null, true from crawl""",
        "header": """
            select site, count(*) as total_pages, count(distinct module) as modules,
              min(start_url) as start_url,
              coalesce((select total_external_links from ext_counts e where e.site = f.site), 0)
                as total_external_links,
              coalesce((select external_links_checked from ext_counts e where e.site = f.site), 0)
                as external_links_checked,
              (select count(*) from broken b where b.site = f.site) as broken_links,
              site || '.test' as base_domain,
              (select crawl_seconds from runs r where r.site = f.site) as crawl_time,
              (select respect_robots from runs r where r.site = f.site) as respect_robots
            from feats f group by site""",
        "advice": "select t.*, " + ", ".join(
            f"(select count(*) from iss i where i.site = t.site and i.issue_type = {q(kind)}) as {name}"
            for name, kind in _COUNTS.items()) + " from totals t",
        "texts": "select site as corpus, site || '|' || module || '|' || issue_type as doc_id, "
                 "description as text from iss",
        "words": _words("texts"),
        "terms": _terms("words"),
        "vocab": _vocab("terms"),
        "doc_texts": "select lang as corpus, doc_id, text from documents",
        "doc_words": _words("doc_texts"),
        "doc_terms": _terms("doc_words"),
        "doc_vocab": _vocab("doc_terms"),
        "drawn_nodes": _drawn_nodes(),
        "drawn": """
            select *, digit % 3 as cluster, 0.5 + digit / 32.0::double as confidence, is_critical as label,
              case when digit < 12 then is_critical else 1 - is_critical end as predicted
            from (select *, site || '|' || module || '|' || issue_type as doc_id,
                    strpos('0123456789abcdef', substr(md5(site || '|' || module || '|' || issue_type), 1, 1)) - 1
                      as digit from iss)""",
        "term_weights": """
            select doc_id, term, raw / sqrt(sum(raw * raw) over (partition by corpus, doc_id)) as w
            from (select t.corpus, t.doc_id, t.term, t.tf * (ln((n + 1) / (df + 1)) + 1) as raw
              from terms t join vocab v on t.corpus = v.corpus and t.term = v.term
              join (select corpus, count(*) as n from texts group by corpus) c on c.corpus = t.corpus)""",
        "pool_words": "select 'all' as corpus, doc_id, word, pos from words",
        "pool_terms": _terms("pool_words"),
        "pool_vocab": _vocab("pool_terms"),
        "pool_vectors": _vectors("pool_words", "pool_terms", "pool_vocab"),
        "site_vectors": _vectors("words", "terms", "vocab"),
        "pool_labels": _lloyd("pool_vectors"),
        "site_labels": _lloyd("site_vectors"),
        "clustered": "select i.*, l.cluster, l.doc_id from iss i join pool_labels l "
                     "on l.doc_id = i.site || '|' || i.module || '|' || i.issue_type",
        "pool_weights": _weights("pool_words", "pool_terms", "pool_vocab"),
        "allowed": _allowed("crawl", "url"),
        "adjacent": _allowed(
            "(select site, regexp_replace(src_url, '[#?].*', '') as src_url, dst_clean as url, min(pos) as pos "
            "from edges where is_internal group by all)", "url"),
    }


def _words(source: str) -> str:
    return f"""
        select corpus, doc_id, unnest(w) as word, generate_subscripts(w, 1) - 1 as pos
        from (select corpus, doc_id, case when len(kept) = 0 then ['issue'] else kept end as w
          from (select corpus, doc_id, list_filter(regexp_split_to_array(regexp_replace(
                  regexp_replace(lower(text), 'https?[^{_SPACE}]+', '', 'g'), '[^a-z\\s]', ' ', 'g'), '\\s+'),
                  lambda x: length(x) > 2 and x not in {in_list(sorted(set(K.STOPWORDS)))}) as kept
                from {source}))"""


def _terms(words: str) -> str:
    return f"""
        select corpus, doc_id, term, count(*) as tf from (
          select corpus, doc_id, word as term from {words} union all
          select corpus, doc_id, word || ' ' || lead(word) over (partition by corpus, doc_id order by pos)
          from {words}) where term is not null group by all"""


def _vocab(terms: str) -> str:
    return f"""
        select * from (select corpus, term, sum(tf)::bigint as total, count(*) as df,
            row_number() over (partition by corpus order by sum(tf) desc, term)::int as term_no
          from {terms} group by corpus, term) where term_no <= 100"""


def _weights(words: str, terms: str, vocab: str) -> str:
    """Weight of every vocabulary term in every document."""
    return f"""
        select corpus, doc_id, term, term_no, raw / sqrt(sum(raw * raw) over (partition by corpus, doc_id)) as w
        from (select t.corpus, t.doc_id, t.term, v.term_no, t.tf * (ln((n + 1) / (df + 1)) + 1) as raw
          from {terms} t join {vocab} v on t.corpus = v.corpus and t.term = v.term
          join (select corpus, count(distinct doc_id) as n from {words} group by corpus) c on c.corpus = t.corpus)"""


def _vectors(words: str, terms: str, vocab: str) -> str:
    """Whole-number weights over the 100 places of the vocabulary, per document of corpora with three or more."""
    return f"""
        select d.corpus, d.doc_id, list(coalesce(x, 0.0) order by t) as v
        from (select distinct corpus, doc_id from {words}) d cross join (select range::int as t from range(1, 101))
        left join (select corpus, doc_id, term_no, round(w * 1048576) as x
                   from ({_weights(words, terms, vocab)})) w
          on w.corpus = d.corpus and w.doc_id = d.doc_id and w.term_no = t
        where d.corpus in (select corpus from {words} group by corpus having count(distinct doc_id) >= 3)
        group by d.corpus, d.doc_id"""


def _lloyd(vectors: str) -> str:
    """Labels of k-means: ten starts per corpus, steps until no centre moves, the cheapest start."""
    far = ("list_transform(centers, lambda c: list_inner_product(c, c) - 2 * list_inner_product(c, v))")
    return f"""
        with recursive seeds as (
          select *, row_number() over (partition by corpus, start order by md5(start || '|' || doc_id), doc_id) as nth
          from {vectors}, (select range as start from range(10))),
        steps(step, corpus, start, centers) as (
          select 0, corpus, start, list(v order by nth)
          from seeds join (select corpus, least(greatest(2, count(*) // 3), 6) as k from {vectors} group by corpus)
            using (corpus) where nth <= k group by corpus, start
          union all
          select step + 1, corpus, start, moved from (
            select step, corpus, start, any_value(centers) as centers,
              list_transform(any_value(centers), lambda old, i: coalesce(
                map(list(c), list(center))[i], list_transform(old, lambda x: 0.0))) as moved
            from (select step, corpus, start, c, any_value(centers) as centers, list(mean order by t) as center
              from (select step, corpus, start, c, t, any_value(centers) as centers, floor(sum(x) / count(*)) as mean
                from (select step, corpus, start, centers, list_position({far}, list_min({far})) as c,
                        unnest(v) as x, generate_subscripts(v, 1) as t
                      from steps join {vectors} using (corpus))
                group by step, corpus, start, c, t) group by step, corpus, start, c)
            group by step, corpus, start)
          where moved <> centers and step < 60),
        ends as (select corpus, start, arg_max(centers, step) as centers from steps group by corpus, start),
        placed as (select corpus, start, doc_id, list_position({far}, list_min({far})) - 1 as cluster, list_min({far}) as cost
                   from ends join {vectors} using (corpus)),
        best as (select corpus, arg_min(start, cost * 16 + start) as start
                 from (select corpus, start, sum(cost) as cost from placed group by corpus, start) group by corpus)
        select corpus, doc_id, cluster::int as cluster from placed join best using (corpus, start)"""


def _keywords(texts: str, terms: str, vocab: str) -> str:
    return f"""
        select corpus, rank, term as keyword, {even('total', 3)} as score,
          greatest({even('total', 3)} * 100, 1) as cloud_weight
        from (select *, row_number() over (partition by corpus order by total desc, term)::int as rank
          from (select corpus, term, {even('sum(w)', 9)} as total
            from (select corpus, term, raw / sqrt(sum(raw * raw) over (partition by corpus, doc_id)) as w
              from (select t.corpus, t.doc_id, t.term, t.tf * (ln((n + 1) / (df + 1)) + 1) as raw
                from {terms} t join {vocab} v on t.corpus = v.corpus and t.term = v.term
                join (select corpus, count(*) as n from {texts} group by corpus having n >= 3) c
                  on c.corpus = t.corpus)) group by corpus, term)) where rank <= 20"""


def _profile(drawn: str, weights: str) -> str:
    """Profile of the clusters in a table of labelled issues."""
    return _drawn_profile().replace("from drawn", f"from {drawn}").replace("join drawn", f"join {drawn}").replace(
        "term_weights", weights)


def _drawn_profile() -> str:
    first = lambda source, order, n: (
        f"(select *, row_number() over (partition by cluster order by {order}) as nth from {source} qualify nth <= {n})")
    sums = (f"(select cluster, term, {even('sum(w)', 9)} as score from term_weights join drawn using (doc_id) "
            "group by cluster, term having sum(w) > 0)")
    modules = "(select cluster, module, count(*) as n from drawn group by all)"
    return f"""
        select cluster, 'Cluster ' || (cluster + 1) || ': ' || head as label, keywords, "count",
          "count" / (select count(*) from drawn)::double as share, "count" < {K.SMALL_SAMPLE_BELOW} as small_sample,
          examples, top_modules, severities
        from (select cluster, count(*) as "count" from drawn group by cluster)
        join (select cluster, string_agg(term, ', ' order by nth) as keywords, arg_min(term, nth) as head
              from {first(sums, 'score desc, term', 5)} group by cluster) using (cluster)
        join (select cluster, string_agg(description, ' | ' order by nth) as examples
              from {first('drawn', 'site, phase, pos, rule_no, form_no, doc_id', 3)} group by cluster) using (cluster)
        join (select cluster, string_agg(module || ': ' || n, ', ' order by nth) as top_modules
              from {first(modules, 'n desc, module', 3)} group by cluster) using (cluster)
        join (select cluster, '{{' || string_agg('"' || severity || '":' || n, ',' order by severity) || '}}' as severities
              from (select cluster, severity, count(*) as n from drawn group by all) group by cluster) using (cluster)"""


def _drawn_report() -> str:
    ratio = lambda a, b: f"coalesce({a} / nullif({b}, 0)::double, 0)"
    share = lambda m: f"coalesce(sum({m} * support) / nullif(sum(support), 0)::double, 0)"
    return f"""
        with classes as (
          select c::varchar as class, {ratio('hit', 'claimed')} as precision, {ratio('hit', 'support')} as recall, support
          from (select c, (select count(*) from drawn where label = c and predicted = c) as hit,
                  (select count(*) from drawn where predicted = c) as claimed,
                  (select count(*) from drawn where label = c) as support
                from (values (0), (1)) v(c))),
        scored as (select *, {ratio('2 * precision * recall', '(precision + recall)')} as f1_score from classes)
        select class, precision, recall, f1_score, support from scored
        union all select 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support)::bigint from scored
        union all select 'weighted avg', {share('precision')}, {share('recall')}, {share('f1_score')},
          sum(support)::bigint from scored"""


def _allowed(source: str, url: str) -> str:
    rest = f"regexp_extract({url}, '^https?://[^/]*(.*)$', 1)"
    return (f"select * from {source} where {rest} like '/help/10%' or not "
            f"({rest} like '/help%' or {rest} like '/privacy%')")


def _features() -> str:
    null = lambda c: f"case when has_html then {c} end as {c}"
    columns = ["title", "meta_description", "img_total", "img_missing_alt", "form_count", "button_count",
               "has_canonical", "has_viewport", "has_og", "h1_count", "element_count", "scripts"]
    return ("select site, ord, url, status_code, load_time, error, has_html, module, depth, "
            + ", ".join(map(null, columns))
            + ", case when has_html then title <> '' end as has_title"
            ", case when has_html then meta_description <> '' end as has_meta_description from feats")


_ISSUE = ("site, page_url, module, issue_type, severity, status, occurrences, fix_time_hours, "
          "description, source")


def _focus() -> str:
    cases = " ".join(f"when contains(lower(module), {q(k.lower())}) then {q(v)}" for k, v in K.MODULE_FOCUS)
    return f"case {cases} else {q(K.DEFAULT_FOCUS)} end"


def _top(source: str, keys: str, order: str, n: int) -> str:
    return (f"select * from (select *, row_number() over (partition by {keys} order by {order})::int "
            f"as rank from ({source})) where rank <= {n}")


def _benchmarks() -> str:
    row = lambda metric, value, standard, result: (
        f"select site, {q(metric)} as metric, {value} as this_site, {q(standard)} as industry_standard, "
        f"{result} as result from advice where issues > 0")
    when = lambda cond, other: f"case when {cond} then {q(K.GOOD)} else {q(other)} end"
    return " union all ".join([
        row("Average Load Time", shown("avg_load", 2) + " || 's'", "< 2.0s",
            f"case when avg_load < 2 then {q(K.GOOD)} when avg_load < 4 then {q(K.NEEDS_WORK)} "
            f"else {q(K.POOR)} end"),
        row("Broken Link Rate", "broken || '/' || pages", "0", when("broken = 0", K.POOR)),
        row("Pages With Meta Description", "with_meta || '/' || pages", "100%",
            when("with_meta = pages", K.NEEDS_WORK)),
        row("Images With Alt Text", "(images - missing_alts) || '/' || images", "100%",
            when("missing_alts = 0", K.NEEDS_WORK)),
        row("Pages With Viewport Meta", "with_viewport || '/' || pages", "100%",
            when("with_viewport = pages", K.POOR)),
    ])


def _summary() -> str:
    values = ["start_url", "total_pages::varchar", "modules::varchar",
              "(select count(*) from iss i where i.site = h.site)::varchar", "broken_links::varchar",
              "external_links_checked::varchar", f"coalesce(crawl_time::varchar || 's', {q(K.NOT_KNOWN)})",
              f"case when respect_robots then 'Yes' when not respect_robots then 'No' else {q(K.NOT_KNOWN)} end"]
    return " union all ".join(
        f"select site, {q(metric)} as metric, {value} as value, {q(meaning)} as meaning from header h"
        for (metric, meaning), value in zip(K.SUMMARY_MEANINGS, values))


def _results() -> str:
    counts = ["total_pages", "modules", "broken_links", "external_links_checked", "total_external_links"]
    crawled = "not nowhere and not blocked"
    return f"""
        select site, url, case when {crawled} then regexp_extract(url, '^https://([^/]*)', 1) end as base_domain,
          {", ".join(f"case when {crawled} then coalesce({c}, 0) end as {c}" for c in counts)},
          case when {crawled} then crawl_seconds end as crawl_time,
          case when nowhere then {q(K.NO_DOMAIN_MESSAGE)} when blocked then {q(K.BLOCKED_ERROR)} end as error,
          case when blocked then {q(K.BLOCKED_MESSAGE)} end as message
        from (select r.site, r.start_url as url, r.crawl_seconds, {", ".join("h." + c for c in counts)},
                r.start_url like 'https:///%' as nowhere,
                r.start_url like '%/privacy' and r.respect_robots as blocked
              from runs r left join header h on h.site = r.site)"""


def _split() -> str:
    return """
        select row_key, label, dense_rank() over (order by module) - 1.0::double as module_enc,
          dense_rank() over (order by issue_type) - 1.0::double as type_enc, occurrences::double as occurrences,
          fix_time_hours, severity_weight,
          row_number() over (partition by label order by md5('42|' || row_key), row_key)
            <= (select n_c - kept from (
                  select label, n_c, kept + (row_number() over (order by quota - kept desc, label)
                      <= train - sum(kept) over ())::int as kept
                  from (select *, floor(quota) as kept from (
                    select label, n_c, n - ceil(n * 0.3::double) as train,
                      n_c * (n - ceil(n * 0.3::double)) / n as quota
                    from (select is_critical as label, count(*) as n_c,
                            (select count(*) from iss) as n from iss group by 1)))) s
                where s.label = r.label) as is_test
        from (select *, site || '|' || module || '|' || issue_type as row_key, is_critical as label
              from iss) r"""


def _drawn_nodes() -> str:
    inner = 2 ** DRAWN_DEPTH - 1
    digits = ", ".join(f"strpos('0123456789abcdef', substr(md5(tree || '|' || node), {k}, 1)) - 1 as d{k}"
                       for k in range(1, 6))
    return f"""
        select tree, node, case when node < {inner} then d1 % 5 else -1 end as feature,
          case when node < {inner} then tops[d1 % 5 + 1] * d2 / 16 end as threshold,
          case when node < {inner} then 2 * node + 1 else -1 end as below,
          case when node < {inner} then 2 * node + 2 else -1 end as above,
          (d3 + 1) / 32.0::double as gain, d4 + 1.0::double as weight,
          1 - d5 / 16.0::double as share_0, d5 / 16.0::double as share_1
        from (select tree, node, {digits} from range({DRAWN_TREES}) t(tree), range({2 * inner + 1}) n(node)),
          (select [(count(distinct module) - 1)::double, (count(distinct issue_type) - 1)::double,
             max(occurrences)::double, max(fix_time_hours)::double, 3.0::double] as tops from iss)"""


def walked(rows: str, nodes: str = "drawn_nodes", trees: int = DRAWN_TREES, depth: int = DRAWN_DEPTH) -> str:
    """Class probabilities per ``key`` of rows (key, x), x being the five features."""
    at = f"select key, x, tree, 0 as node from ({rows}), range({trees}) t(tree)"
    for _ in range(depth):
        at = f"""select key, x, w.tree, case when feature < 0 then w.node
                when x[feature + 1] <= threshold then below else above end as node
            from ({at}) w join {nodes} n on n.tree = w.tree and n.node = w.node"""
    return f"""select key, sum(share_0::decimal(18, 15))::double / {trees} as p0,
              sum(share_1::decimal(18, 15))::double / {trees} as p1
            from ({at}) w join {nodes} n on n.tree = w.tree and n.node = w.node group by key"""


_X = "[module_enc, type_enc, occurrences::double, fix_time_hours::double, severity_weight::double]"


def _drawn_forest_scores() -> str:
    codes = lambda c: f"(select {c}, row_number() over (order by {c}) - 1.0::double as code from (select distinct {c} from iss))"
    rows = f"""(select row_number() over () as key, i.*, coalesce(m.code, 0) as module_enc, coalesce(t.code, 0) as type_enc
        from (select * replace (case when length(module) % 7 = 0 then 'New ' || module else module end as module)
              from iss) i
        left join {codes('module')} m on m.module = i.module
        left join {codes('issue_type')} t on t.issue_type = i.issue_type)"""
    return f"""
        with scoring as materialized {rows}
        select module, issue_type, occurrences::double as occurrences, fix_time_hours as fix_time, severity,
          case when p1 > p0 then {q(K.LABEL_NAMES[1])} else {q(K.LABEL_NAMES[0])} end as prediction,
          {even('greatest(p0, p1) * 100', 1)} as confidence, {even('p1 * 100', 1)} as proba_critical,
          {even('p0 * 100', 1)} as proba_not_critical
        from scoring join ({walked(f"select key, {_X} as x from scoring")}) using (key)"""


def importance(nodes: str) -> str:
    labels = ", ".join(f"({i}, {q(label)})" for i, (_, label) in enumerate(K.FEATURE_LABELS))
    return f"""
        select label as feature, coalesce(s / sum(s) over (), 0) as importance,
          {even('coalesce(s / sum(s) over (), 0) * 100', 1)} as importance_pct
        from (values {labels}) v(no, label) left join (
          select feature, sum((g / nullif(total, 0))::decimal(18, 15))::double as s
          from (select feature, g, sum(g) over (partition by tree) as total
                from (select tree, feature, sum(gain * weight) as g from {nodes} where feature >= 0 group by all))
          group by feature) on feature = no"""


def _bodies() -> dict[str, str]:
    module, path = module_sql("url"), "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"
    pdf_kept = "md5(html) as html_md5"
    host = "replace(regexp_extract(url, '^https?://([^/?#]*)', 1), 'www.', '')"
    return {
        "crawl_scan": f"select site, ord, url, status_code, content_type, load_time, error, {pdf_kept} from crawl",
        "seed_urls": f"""
            select page_id, error = '' as is_valid, url, error from (
              select page_id, url, case when contains(h, '[') <> contains(h, ']') then {q(K.UNPARSABLE_MESSAGE)}
                  when h = '' then {q(K.NO_DOMAIN_MESSAGE)} else '' end as error
              from (select *, regexp_extract(url, '^https?://([^/?#]*)', 1) as h from (
                select page_id, case when regexp_matches(trim(raw), '^https?://') then trim(raw)
                    else 'https://' || trim(raw) end as url
                from (select page_id, case when page_id % 5 = 1 then bare
                        when page_id % 5 = 2 then '  ' || bare || ' '
                        when page_id % 11 = 3 then 'https:///nowhere'
                        when page_id % 13 = 4 then '[' || bare else url end as raw
                      from (select *, regexp_replace(url, '^https?://', '') as bare from pages)))))""",
        "url_clean": "select page_id, split_part(split_part(url, '#', 1), '?', 1) as clean from pages",
        "url_module": f"select page_id, {module} as module from pages",
        "page_depth": f"select page_id, len(list_filter(string_split({path}, '/'), lambda s: s <> ''))::int "
                      "as depth from pages",
        "same_domain": f"select page_id, {host} = 'cheap-pills.example.com' "
                       f"or ends_with({host}, '.cheap-pills.example.com') as is_internal from pages",
        "page_features": _features(),
        "page_headings": f"select site, url, level, pos::int as pos, {text_sql('raw')} as text from headings",
        "page_forms": "select * from forms",
        "page_links": "select * from edges",
        "external_links": "select * from ext",
        "external_link_counts": "select * from ext_counts",
        "broken_links": "select * from broken",
        "broken_links_first20": "select * from broken20",
        "robots_allowed": "select site, url from allowed",
        "robots_by_run": "select site, url from allowed where site <> 'site-3' union all "
                         "select site, url from crawl where site = 'site-3'",
        "link_reach": _visits("true"),
        "link_reach_first50": _visits("visit_no <= 50"),
        "issues_raw": f"select {_ISSUE} from raw",
        "issue_ids": "select site, row_number() over (partition by site order by phase, pos, rule_no, form_no) "
                     "as id, page_url, issue_type, form_no::int as form_no from raw",
        "issues": f"select {_ISSUE} from iss",
        "issue_flags": "select site, module, issue_type, severity_weight, is_critical, is_recurring, is_open from iss",
        "issue_listing": "select site, " + ", ".join(
            f'{c} as "{label}"' for c, label in K.LISTING_COLUMNS) + " from iss",
        "issue_defaults": f"""
            select site, module, issue_type, {q('Unknown')} as status, {q('Unknown')} as occurrences,
              {q('Unknown')} as fix_time_hours, {q('Unknown')} as description, severity_weight, is_critical,
              0 as is_recurring, 0 as is_open from iss""",
        "export_rows": f"select site, {', '.join(K.EXPORT_COLUMNS)} from iss",
        "health_scores": f"""
            select site, score, case when score >= 80 then 'A' when score >= 65 then 'B'
                when score >= 50 then 'C' when score >= 35 then 'D' else 'F' end as grade,
              case when score >= 80 then 'green' when score >= 65 then 'orange'
                when score >= 50 then '#FF8C00' when score >= 35 then 'red' else 'darkred' end as color
            from (select site, {_HEALTH} as score from scores)""",
        "health_breakdown": " union all ".join(
            f"select site, {q(name)} as category, {even(column, 1)} as score from scores"
            for name, column in _SCORE.items()),
        "module_risk": "select * from risk",
        "risk_components": f"""
            select site, module, {even('issue_count * 0.4::double', 2)} as issue_volume,
              {even('avg_severity_weight * 10 * 0.35::double', 2)} as severity,
              {even('broken_link_rate * 100 * 0.25::double', 2)} as broken_links from risk""",
        "risk_display": f"""
            select site, module, issue_count, open_issues, high_severity,
              {shown('broken_link_rate * 100', 1)} || '%' as broken_link_rate,
              {shown('risk_score', 1)} as risk_score, risk_level,
              case when small_sample then {q(K.SMALL_SAMPLE_TEXT)} else {q(K.ENOUGH_SAMPLE_TEXT)} end
                as small_sample from risk""",
        "risk_small_sample": "select site, module, issue_count from risk where small_sample",
        "issue_type_top12": _top("select site, issue_type, count(*) as count from iss group by all", "site",
                                 "count desc, issue_type", 12),
        "module_counts": "select site, module, count(*) as count from iss group by all",
        "severity_share": "select site, severity, count(*) as count, "
                          "count(*) / sum(count(*)) over (partition by site) as share from iss group by site, severity",
        "status_counts": "select site, status, count(*) as count from iss group by all",
        "module_severity_pivot": "select site, module, " + ", ".join(
            f"count(*) filter (severity = '{s}') as \"{s}\"" for s in ("Low", "Medium", "High"))
            + " from iss group by site, module",
        "slowest_pages": """
            select site, url, module, load_time, rank, case when load_time > 3 then 'red'
                when load_time > 1.5 then 'orange' else 'green' end as band, '…' || right(url, 45) as page
            from (""" + _top("select site, url, module, load_time from feats where load_time > 0", "site",
                             "load_time desc, url", 25) + ")",
        "load_summary": """
            select site, count(*) as measured_pages, sum(load_time::decimal(18, 3))::double / count(*) as avg_load,
              count(*) filter (load_time > 3) as slow_pages from feats where load_time > 0 group by site""",
        "worst_pages": _top(
            "select site, page_url, count(*) as total_issues, sum(is_critical)::bigint as high_severity, "
            "sum(is_open)::bigint as open_issues from iss group by all", "site", "total_issues desc, page_url", 10),
        "module_cards": """
            select *, case when high_issues > 0 then high_issues || ' HIGH'
                when total_issues > 0 then total_issues || ' issues' else '✓ clean' end as badge
            from (select p.*, coalesce(total_issues, 0) as total_issues,
                coalesce(high_issues, 0)::bigint as high_issues, coalesce(open_issues, 0)::bigint as open_issues,
                coalesce(top_types, '') as top_types
              from (select site, module, count(*) as page_count, coalesce(
                      sum(load_time::decimal(18, 3)) filter (load_time > 0)::double
                      / nullif(count(*) filter (load_time > 0), 0), 0) as avg_load from feats group by all) p
              left join (select site, module, count(*) as total_issues, sum(is_critical) as high_issues,
                           sum(is_open) as open_issues from iss group by all) i using (site, module)
              left join (select site, module, string_agg(issue_type, ', ' order by rank) as top_types from ("""
        + _top("select site, module, issue_type, count(*) as count from iss group by all", "site, module",
               "count desc, issue_type", 3) + ") group by all) t using (site, module))",
        "module_examples": """
            select site, module, rank, status_code,
              case when length(url) > 32 then '…' || right(url, 32) else url end as short_url,
              greatest(n - 2, 0) as more_pages
            from (select site, module, url, status_code,
                    row_number() over (partition by site, module order by ord)::int as rank,
                    count(*) over (partition by site, module) as n from feats) where rank <= 2""",
        "site_modules": "select distinct site, module from feats",
        "scoring_choices": "select distinct site, 'module' as field, module as value from iss union all "
                           "select distinct site, 'issue_type', issue_type from iss",
        "kpi_strip": f"""
            select h.site, total_pages, modules, broken_links,
              coalesce(crawl_time::varchar || 's', {q(K.NOT_KNOWN)}) as crawl_time, coalesce(issues, 0) as issues,
              coalesce(high, 0) as high, coalesce(medium, 0) as medium, coalesce(low, 0) as low,
              coalesce(open, 0) as open, coalesce(fixed, 0) as fixed, coalesce(reopened, 0) as reopened
            from header h left join (select site, count(*) as issues,
                count(*) filter (severity = 'High') as high, count(*) filter (severity = 'Medium') as medium,
                count(*) filter (severity = 'Low') as low, sum(is_open)::bigint as open,
                count(*) filter (status = 'Fixed') as fixed, count(*) filter (status = 'Reopened') as reopened
              from iss group by site) i on h.site = i.site""",
        "crawl_header": "select * from header",
        "crawl_results": _results(),
        "crawl_summary": _summary(),
        "score_explanation": f"""
            select site, score, case when score >= 80 then 'A' when score >= 65 then 'B'
                when score >= 50 then 'C' when score >= 35 then 'D' else 'F' end as grade,
              concat_ws('; ', case when high_issues = 0
                then 'none of the ' || issues || ' issues are High-severity'
                else 'only ' || high_issues || ' of the ' || issues || ' issues are High-severity ('
                  || {shown('high_issues / pages', 1)}
                  || ' per page) — the Issues score rewards low high-severity density' end,
                case when broken > 0 then broken
                  || ' broken link(s) are the biggest drag on your grade (Broken Links score = '
                  || {shown(even('s_broken', 1), 0)} || '/100)' end) as explanation
            from (select *, {_HEALTH} as score from scores)""",
        "category_table": _category_table(),
        "clean_tokens": "select corpus, doc_id, pos::int as pos, word from words",
        "ngrams": "select * from terms",
        "vocabulary": "select * from vocab",
        "tfidf_keywords": _keywords("texts", "terms", "vocab"),
        "document_keywords": _keywords("doc_texts", "doc_terms", "doc_vocab"),
        "text_guard": f"""
            select corpus, count(*) as n_docs, case when count(*) < 3 then {q(K.TEXT_GUARD_MESSAGE)} end as error
            from texts group by corpus""",
        "module_codes": "select value, row_number() over (order by value) - 1.0::double as code "
                        "from (select distinct module as value from iss)",
        "train_test_split": _split(),
        "model_guard": f"select count(*) as n_issues, case when count(*) < {K.MIN_ISSUES_FOR_MODEL} "
                       f"then {q(K.MODEL_GUARD_MESSAGE)} end as error from iss",
        "one_class_repair": """
            select row_key || suffix as row_key, augmented,
              case when augmented and row_key = min(row_key) over () then 1 else 0 end as label
            from (select site || '|' || module || '|' || issue_type as row_key from iss where is_critical = 0),
              (values (false, ''), (true, '|copy')) v(augmented, suffix)""",
        "drawn_forest_predictions": f"""
            with test as materialized (select * from ({_split()}) where is_test)
            select row_key as issue, label as actual, (p1 > p0)::int as predicted, greatest(p0, p1) as confidence
            from test join ({walked(f"select row_key as key, {_X} as x from test")}) on key = row_key""",
        "drawn_forest_scores": _drawn_forest_scores(),
        "drawn_forest_importance": importance("drawn_nodes"),
        "drawn_confusion": """
            select c::int as actual, (select count(*) from drawn where label = c and predicted = 0) as predicted_0,
              (select count(*) from drawn where label = c and predicted = 1) as predicted_1
            from (values (0), (1)) v(c)""",
        "drawn_model_cards": f"""
            select {even('count(*) filter (label = predicted) / count(*)::double', 4)} as accuracy,
              count(*) as test_rows, avg(confidence) as avg_confidence from drawn""",
        "drawn_report": f"select * from ({_drawn_report()})",
        "issue_clusters": "select site, module, issue_type, cluster from clustered",
        "site_clusters": "select site, module, issue_type, cluster from iss join site_labels "
                         "on doc_id = site || '|' || module || '|' || issue_type",
        "cluster_profile": _profile("clustered", "pool_weights"),
        "drawn_cluster_modules": 'select cluster, module, count(*) as "count" from drawn group by all',
        "drawn_cluster_profile": _drawn_profile(),
        "recommendations": _recommendations(),
        "clean_site_advice": _rec(1, K.REC_NONE, "true", q(K.REC_NONE_TITLE)),
        "recurrence_flags": _flag(K.FLAG_BROKEN, "broken > 0") + " union all " + _flag(K.FLAG_SLOW, "slow > 0"),
        "priority_tests": f"select site, rank, module, risk_score, risk_level, open_issues, {_focus()} as test_focus "
                          "from (" + _top("select * from risk", "site", "risk_score desc, module", 5) + ")",
        "benchmarks": _benchmarks(),
    }


#: Each step keeps, of the pages not seen before, the first path to each.
_WALK = """walk(site, url, level, path) using key (site, url) as (
    select distinct site, regexp_replace(start_url, '[#?].*', ''), 0, '' from crawl
    union
    select a.site, a.url, w.level + 1, min(w.path || lpad(a.pos::varchar, 6, '0') || '.')
    from walk w join adjacent a on a.site = w.site and a.src_url = w.url
    where not exists (from recurring.walk r where r.site = a.site and r.url = a.url)
    group by a.site, a.url, w.level)"""


def statements() -> dict[str, str]:
    """Every oracle as one statement with just the common tables it needs."""
    ctes = _ctes()

    def needed(text: str, have: set[str]) -> set[str]:
        for name in ctes:
            if name not in have and re.search(rf"\b(?:from|join)\s+{name}\b", text):
                have.add(name)
                needed(ctes[name], have)
        return have

    result = {}
    for name, body in _bodies().items():
        walks = "from walk" in body
        use = needed(body + (_WALK if walks else ""), set())
        parts = [f"{c} as materialized ({ctes[c]})" for c in ctes if c in use]
        if walks:
            parts.append(_WALK)
        head = "with recursive " if walks else "with "
        if body.lstrip().startswith("with "):
            body = f"select * from ({body})"
        result[name] = (head + ", ".join(parts) + " " if parts else "") + body
    return result
