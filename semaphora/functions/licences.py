"""Licence names: family, identifier, address; and attribution text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of licence names, and the terms of a licence that has no address of its own.
CC_BY = r"(?i)\ACC[ -]BY[ -](\d\.\d)(?:[ -]([a-z]{2,3}))?\z"
CC_BY_SA, CC0, PUBLIC = r"(?i)\ACC[ -]BY[ -]SA\b", r"(?i)\ACC0(?:[ -]1\.0)?\z", r"(?i)\A(?:public domain|pd(?:[ -].*)?)\z"
ATTRIBUTION_URL = "https://commons.wikimedia.org/wiki/Template:Attribution"
ALLOWED = ["cc_by", "cc0", "public_domain", "attribution"]


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def licence_class(name: Column) -> Column:
    """The family of a licence name; the first form that fits decides, null and unknown names are 'other'."""
    t = stripped(name)
    return F.when(t.rlike(CC_BY), "cc_by").when(t.rlike(CC_BY_SA), "cc_by_sa").when(t.rlike(CC0), "cc0").when(t.rlike(PUBLIC), "public_domain").when(F.lower(t) == "attribution", "attribution").otherwise("other")


def spdx_id(name: Column) -> Column:
    """The identifier of an allowed licence, else null. A ported licence keeps its land."""
    t, family = stripped(name), licence_class(name)
    land = F.upper(F.regexp_extract(t, CC_BY, 2))
    by = F.concat(F.lit("CC-BY-"), F.regexp_extract(t, CC_BY, 1), F.when(land != "", F.concat(F.lit("-"), land)).otherwise(""))
    return F.when(family == "cc0", "CC0-1.0").when(family == "public_domain", "LicenseRef-PublicDomain").when(family == "attribution", "LicenseRef-Commons-Attribution").when(family == "cc_by", by)


def licence_url(name: Column, stated: Column) -> Column:
    return F.coalesce(F.nullif(stated, F.lit("")), F.when(licence_class(name) == "attribution", ATTRIBUTION_URL))


def _collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def plain_html(html: Column) -> Column:
    """Text without tags, white space collapsed, three entities decoded in this order; empty becomes null."""
    t = _collapsed(F.regexp_replace(html, "<[^>]*>", ""))
    for entity, char in (("&amp;", "&"), ("&quot;", '"'), ("&#039;", "'")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.nullif(t, F.lit(""))


def markdown(text: Column) -> Column:
    return F.regexp_replace(_collapsed(text), r"([\\`*_\[\]<>|])", r"\\$1")


def attribution(title: Column, author: Column, licence: Column, url: Column, credit: Column, modification: Column) -> Column:
    """One entry of an attribution list."""
    entry = F.concat(F.lit("["), markdown(title), F.lit("](<"), url, F.lit(">) by "), F.coalesce(markdown(F.nullif(author, F.lit(""))), F.lit("unknown author")), F.lit(", "), markdown(licence), F.lit("."))
    said = F.coalesce(F.nullif(credit, F.lit("")), F.lit("own work"))
    entry = F.concat(entry, F.when(F.lower(stripped(said)) != "own work", F.concat(F.lit(" Credit: "), F.regexp_replace(markdown(said), r"\.+\z", ""), F.lit("."))).otherwise(""))
    return F.concat(entry, F.when(F.coalesce(modification, F.lit("")) != "", F.concat(F.lit(" Modified ("), markdown(modification), F.lit(")."))).otherwise(""))
