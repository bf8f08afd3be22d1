"""Markup to text as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse

#: The entities that are decoded by name.
ENTITIES = {
    "nbsp": " ", "quot": '"', "apos": "'", "lt": "<", "gt": ">", "mdash": "—", "ndash": "–", "hellip": "…", "laquo": "«", "raquo": "»",
    "ldquo": "“", "rdquo": "”", "ordm": "º", "scaron": "š", "Scaron": "Š", "middot": "·", "aacute": "á", "Aacute": "Á", "eacute": "é", "Eacute": "É",
    "iacute": "í", "Iacute": "Í", "oacute": "ó", "Oacute": "Ó", "uacute": "ú", "Uacute": "Ú", "ntilde": "ñ", "Ntilde": "Ñ", "uuml": "ü", "Uuml": "Ü",
    "auml": "ä", "euml": "ë", "iuml": "ï", "ouml": "ö", "acirc": "â", "ecirc": "ê", "icirc": "î", "ocirc": "ô", "ucirc": "û",
    "agrave": "à", "egrave": "è", "igrave": "ì", "ograve": "ò", "ugrave": "ù", "amp": "&",
}


def decode_entities(text: Column) -> Column:
    """Numeric references first, then named ones; unknown names stay."""
    parts = F.split(text, r"(?=&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});)")
    number = lambda p: F.regexp_extract(p, r"^&#([0-9]{1,7});", 1)
    hexed = lambda p: F.regexp_extract(p, r"^&#[xX]([0-9a-fA-F]{1,6});", 1)
    code = lambda p: F.coalesce(F.try_to_number(F.nullif(number(p), F.lit("")), F.lit("9999999")).cast("int"), F.conv(F.nullif(hexed(p), F.lit("")), 16, 10).cast("int"))
    char = lambda p: F.decode(F.unhex(F.lpad(F.hex(code(p)), 8, "0")), "UTF-32")
    known = lambda p: code(p).between(1, 0xD7FF) | code(p).between(0xE000, 0x10FFFF)
    put = lambda p: F.when(known(p), F.concat(char(p), F.regexp_replace(p, "^&#[0-9a-fA-FxX]+;", ""))).otherwise(p)
    numeric = F.when(F.contains(text, F.lit("&#")), F.array_join(F.transform(parts, put), "")).otherwise(text)
    return reduce(lambda t, kv: F.replace(t, F.lit(f"&{kv[0]};"), F.lit(kv[1])), ENTITIES.items(), numeric)


def strip_tags(html: Column) -> Column:
    return collapse(decode_entities(F.regexp_replace(html, "<[^>]+>", " ")))


def blocks(html: Column) -> Column:
    """Lines of text: scripts, styles and comments dropped, block tags and breaks are line ends."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    broken = F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"(?i)<br\s*/?>|</?(?:p|div|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|aside|main)\b[^>]*>", "\n")
    lines = F.transform(F.split(broken, "\n"), strip_tags)
    return F.filter(lines, lambda x: x != "")


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\b[^>]*?\bhref="([^"]*)"'), 1)
