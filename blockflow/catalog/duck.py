"""SQL fragments for DuckDB that several oracle queries share."""

from blockflow.rules import languages as lg


def sql_list(words) -> str:
    return "[" + ",".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_in(words) -> str:
    return "(" + ",".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def put(template: str, x: str) -> str:
    return template.replace("§", x)


def strip(x: str) -> str:
    return put(r"regexp_replace(§, '^\s+|\s+$', '', 'g')", x)


def collapse(x: str) -> str:
    return put(r"regexp_replace(§, '\s+', ' ', 'g')", strip(x))


def fold(x: str) -> str:
    return put("replace(lower(§), 'ß', 'ss')", x)


def bare(x: str) -> str:
    return fold(put(r"""regexp_replace(§, '[\s"''¿¡!?.,;:()\[\]{}_\-]+', '', 'g')""", x))


def triple(x: str) -> str:
    return put("(len(list_filter(range(1, length(§) - 1), lambda k: substr(§, k, 1) = "
               "substr(§, k + 1, 1) and substr(§, k, 1) = substr(§, k + 2, 1))) > 0)", x)


def n_match(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def chars(x: str) -> str:
    """Distinct lower-case characters."""
    return put("len(list_distinct(string_split(lower(§), '')))", x)


def plain(x: str) -> str:
    """Lower case without accents, ASCII only."""
    return put(r"regexp_replace(regexp_replace(strip_accents(lower(§)), '[^\x00-\x7f]', '', 'g'), '^\s+|\s+$', '', 'g')", x)


GARBAGE = r"""(§ <> '' and not regexp_matches(§, '[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}]') and (
  regexp_matches(§, '^[\d\s.,;:''"\-_~]+$')
  or regexp_matches(§, '\d[A-Z]{5,}|[A-Z]{6,}\d|\d{2,}[A-Z]{2,}\d{2,}')
  or len(regexp_extract_all(§, '\p{Nd}')) > 0.4 * length(§)
  or len(regexp_extract_all(§, '[@#$%^&*+=<>\[\]{}|\\/]')) >= 3
  or (length(regexp_replace(§, '\P{L}', '', 'g')) <= 2
      and not regexp_matches(regexp_replace(§, '\P{L}', '', 'g'), '[aeiouAEIOU]')
      and not regexp_matches(regexp_replace(§, '\P{L}', '', 'g'), '[^\x00-\x7f]'))))"""


def garbage(x: str) -> str:
    return put(GARBAGE, x)


def has_common(x: str, lang: str) -> str:
    stripped = (r"""regexp_replace(§, '^[.,;:!?¿¡()\[\]{}"'']+|[.,;:!?¿¡()\[\]{}"'']+$', '', 'g')"""
                .replace("§", fold("w")))
    return (f"list_has_any(list_transform(string_split_regex({x}, '\\s+'), lambda w: {stripped}), "
            f"{sql_list(lg.COMMON_WORDS[lang])})")
