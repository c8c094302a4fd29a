r"""SQL expressions over HTML, built from regular expressions that stay inside the JVM.

Every function takes and returns SQL text, so a whole page audit is parsed in a few
calls. An HTML parser sees no tags inside comments, scripts and styles, so those are
blanked first. Attribute values are read tag by tag, so a quoted '>' or a look-alike
name inside another value does not mislead. Patterns write the single quote as \x27.
"""

from sitegauge import constants as K

# Inside of a start tag: a quoted value after '=' may hold '>'. Possessive, so it
# neither backtracks nor recurses on long pages.
_INSIDE = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|\x27[^\x27]*+\x27)?+)*+"""
_NAME_END = r"(?=[\s/>])"
_NAME = r"[a-zA-Z][^\s/>]*+"
_ATTRIBUTE = r"""[^\s/>][^\s/=>]*(?:\s*=+\s*(?:\x27[^\x27]*\x27|"[^"]*"|(?!["\x27])[^>\s]*))?"""
#: A start tag that never ends, and all of the page after it, so that none is searched twice.
_UNENDED = "<[a-zA-Z](?s:.*)"


def _element(name: str, end: str) -> str:
    """One element: group 1 is its '>' and content, empty for a start tag that never ends."""
    return rf"(?is)<{name}{_NAME_END}{_INSIDE}(>.*?){end}|<{name}{_NAME_END}.*"


def _end_of(name: str) -> str:
    """End of an element: its end tag, the next start of the same kind, or the page's end.

    So every start tag gives one entry, and an element that is never closed is read once.
    """
    return rf"(?:</{name}\s*+>|(?=<{name}{_NAME_END})|\z)"


def strip_hidden(html: str) -> str:
    """HTML without comments, the content of script and style, and a start tag that never ends.

    What is not closed lasts to the page's end. Every start tag is read whole, so neither a
    comment nor a tag begins inside a quoted value, and each character is read once.
    """
    pattern = (r"(?is)<!--.*?(?:--!?>|\z)"
               rf"|(<(script|style){_NAME_END}{_INSIDE}>).*?(?:</\2[^>]*+(?:>|\z)|\z)"
               rf"|(<{_NAME}{_INSIDE}>)|{_UNENDED}")
    return f"regexp_replace({html}, r'{pattern}', '$1$3')"


def start_tags(html: str) -> str:
    """Full text of all start tags, in document order: one pass that reads each tag once."""
    found = rf"regexp_extract_all({html}, r'(<{_NAME}{_INSIDE}>)|{_UNENDED}', 1)"
    return f"filter({found}, t -> t <> '')"


def tag_names(tags: str) -> str:
    """Lower-cased names of the start tags."""
    return rf"transform({tags}, t -> lower(regexp_extract(t, r'\A<({_NAME})', 1)))"


def named(tags: str, names: str, name: str) -> str:
    """The start tags with this name, given the names of all."""
    return f"filter({tags}, (t, i) -> {names}[i] = '{name}')"


def count_of(names: str, name: str) -> str:
    return f"size(filter({names}, n -> n = '{name}'))"


def decode(text: str) -> str:
    """Replace numeric and the common named character references.

    A lambda over a one-element array binds the text, which may be a long expression.
    """
    named = "t"
    for reference, char in K.NAMED_REFERENCES:
        named = f"replace({named}, '&{reference};', '{char}')"
    number = r"regexp_extract(p, r'\A([xX][0-9a-fA-F]{1,6}|[0-9]{1,7});', 1)"
    code = rf"cast(if({number} rlike r'\A[xX]', conv(substr({number}, 2), 16, 10), {number}) as int)"
    char = (f"if({code} between 1 and 55295 or {code} between 57344 and 1114111, "
            f"decode(unhex(lpad(hex({code}), 8, '0')), 'UTF-32'), decode(unhex('0000FFFD'), 'UTF-32'))")
    numeric = (f"array_join(transform(split({named}, '&#'), (p, i) -> if(i = 0, p, if({number} = '', "
               f"concat('&#', p), concat({char}, substr(p, length({number}) + 2))))), '')")
    whole = f"replace({numeric}, '&amp;', '&')"
    return f"transform(array({text}), t -> if(contains(t, '&'), {whole}, t))[0]"


def attribute(tag: str, name: str) -> str:
    """Decoded value of an attribute: NULL when absent, '' when it has no value.

    The last one wins when an attribute is repeated.
    """
    body = rf"regexp_replace({tag}, r'^<[a-zA-Z][^\s/>]*', '')"
    pieces = f"regexp_extract_all({body}, r'{_ATTRIBUTE}', 0)"
    piece = rf"try_element_at(filter({pieces}, p -> rlike(p, r'\A(?i:{name})\s*(?:=|\z)')), -1)"
    value = rf"regexp_replace({piece}, r'(?s)\A[^=]+=+\s*|\A[^=]+\z', '')"
    return decode(rf"""regexp_replace({value}, r'(?s)\A(["\x27])(.*)\1\z', '$2')""")


def attribute_or_empty(tag: str, name: str) -> str:
    return f"coalesce({attribute(tag, name)}, '')"


def strip_space(text: str) -> str:
    # a run of space is tried from its first character only
    space = rf"[\s{K.OTHER_SPACE}]"
    return rf"regexp_replace({text}, r'\A{space}++|(?<!{space}){space}++\z', '')"


def inner_text(fragment: str) -> str:
    """Text nodes of a fragment, each stripped, joined without a separator."""
    nodes = rf"split({fragment}, r'(?s)<{_NAME}{_INSIDE}(?:>|\z)|</[a-zA-Z][^>]*+(?:>|\z)')"
    return f"array_join(transform({nodes}, x -> {strip_space(decode('x'))}), '')"


def title_text(html: str) -> str:
    """Text of the first title element, '' when there is none."""
    return inner_text(rf"substr(regexp_extract({html}, r'{_element('title', r'(?:</title\s*+>|\z)')}', 1), 2)")


def heading_texts(html: str, level: str) -> str:
    blocks = f"filter(regexp_extract_all({html}, r'{_element(level, _end_of(level))}', 1), b -> b <> '')"
    return f"transform({blocks}, b -> {inner_text('substr(b, 2)')})"


def form_structs(html: str) -> str:
    """Array of struct(action, method, input_count, has_validation)."""
    whole = f"regexp_extract_all({html}, r'{_element('form', _end_of('form'))}', 0)"
    opening = rf"regexp_extract(b, r'\A<{_NAME}{_INSIDE}>', 0)"
    forms = f"filter(transform({whole}, b -> named_struct('opening', {opening}, 'tags', {start_tags('b')})), f -> f.opening <> '')"
    inputs = rf"filter(f.tags, t -> rlike(t, r'\A(?i:<input){_NAME_END}'))"
    validates = (f"{attribute_or_empty('i', 'required')} <> '' or "
                 f"{attribute_or_empty('i', 'pattern')} <> '' or "
                 f"{attribute_or_empty('i', 'type')} = 'email'")
    return (f"transform({forms}, f -> named_struct("
            f"'action', {attribute_or_empty('f.opening', 'action')}, "
            f"'method', upper(coalesce({attribute('f.opening', 'method')}, 'get')), "
            f"'input_count', size({inputs}), "
            f"'has_validation', exists({inputs}, i -> {validates})))")
