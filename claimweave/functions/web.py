"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimweave.functions.vocab import NAMESPACES, OBO_IRI


def domain(url: Column) -> Column:
    """Host in lower case, a port kept, a leading ``www.`` dropped."""
    rest = F.regexp_replace(F.trim(url), r"^https?://", "")
    return F.regexp_replace(F.lower(F.get(F.split(rest, "/", 2), F.lit(0))), r"^www\.", "")


def curie(iri: Column) -> Column:
    """``<obo>/PREFIX_number`` to ``PREFIX:number``; anything else stays."""
    local = F.substr(iri, F.lit(len(OBO_IRI) + 1))
    return F.when(iri.startswith(OBO_IRI), F.regexp_replace(local, r"^([^_]*)_(.+)$", "$1:$2")).otherwise(iri)


def namespace(identifier: Column) -> Column:
    """One spelling per namespace; the local part is kept."""
    prefix = F.upper(F.substring_index(identifier, ":", 1))
    table = F.create_map(*[F.lit(x) for kv in NAMESPACES.items() for x in kv])
    known = F.try_element_at(table, prefix)
    local = F.regexp_replace(identifier, r"^[^:]*:", "")
    return F.when(identifier.contains(":") & known.isNotNull(), F.concat(known, F.lit(":"), local)).otherwise(identifier)


def query_values(url: Column, name: str) -> Column:
    """A query parameter's comma-separated values; none when the parameter is absent."""
    value = F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)
    return F.when(value != "", F.split(value, ",")).otherwise(F.array().cast("array<string>"))


def canonical_target(url: Column, private: tuple[str, ...] = ()) -> Column:
    """The URL with private parameters dropped and the others sorted; a fragment is dropped too."""
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*private))
    return F.when(F.size(pairs) > 0, F.concat(base, F.lit("?"), F.array_join(F.array_sort(pairs), "&"))).otherwise(base)


def request_identity(method: Column, url: Column, key: Column) -> Column:
    """A GET is known by its URL, any other request also by its key."""
    return F.when(F.coalesce(method, F.lit("GET")) == "GET", url).otherwise(F.concat(url, F.lit("#"), key))
