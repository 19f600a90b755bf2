"""Name, path, URL and identity rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..profiles import DATA_EXTENSIONS, DEFAULT_MEDIA_TYPE, MEDIA_TYPES
from .binding import let


def first_truthy(*columns: Column) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns[:-1]], columns[-1])


def _lit(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def safe_component(value: Column, fallback: Column | str = "unknown") -> Column:
    """Last path segment of ``value``, at most 120 characters; ``fallback`` when nothing usable is left."""
    fallback = _lit(fallback)
    text = F.translate(first_truthy(value, fallback), "\\", "/")

    def last_segment(t: Column) -> Column:
        # the pattern only matters for a trailing slash, which is rare
        open_end = t.endswith("/") | t.endswith("/.")
        return F.substring_index(F.when(open_end, F.regexp_replace(t, r"(/\.?)+$", "")).otherwise(t), "/", -1)

    def checked(name: Column) -> Column:
        return F.when(name.isin("", ".", ".."), fallback).otherwise(F.substring(name, 1, 120))

    return let(let(text, last_segment), checked)


def url_path(href: Column) -> Column:
    """Decoded path of a URL. A plus sign is kept; a malformed escape leaves the path as it is."""
    # path parameters (";...") belong to the last segment only
    path = F.regexp_extract(href, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?((?:[^?#;]|;(?=[^?#]*/))*)", 1)

    def decoded(p: Column) -> Column:
        plain = F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p)
        return F.when(p.contains("%"), plain).otherwise(p)

    return let(path, decoded)


def asset_filename(asset_key: Column, href: Column) -> Column:
    fallback = F.concat(safe_component(asset_key, "asset"), F.lit(".data"))
    return safe_component(url_path(F.coalesce(href, F.lit(""))), fallback)


def asset_path(catalog: Column, collection: Column, item_id: Column, filename: Column) -> Column:
    return F.concat_ws(
        "/", F.lit("source"), safe_component(catalog), safe_component(collection), safe_component(item_id), filename
    )


def link_asset_key(filename: Column) -> Column:
    """Last dot-separated part before the extension: ``scene.B04.tif`` gives ``B04``."""
    return safe_component(F.substring_index(F.regexp_replace(filename, r"\.[^.]*$", ""), ".", -1), "data")


def is_data_link(href: Column, rel: Column) -> Column:
    low = F.lower(F.coalesce(href, F.lit("")))
    known = F.lit(False)
    for extension in DATA_EXTENSIONS:
        known = known | low.endswith(extension)
    return known & ~low.contains("opendap") & F.coalesce(rel, F.lit("")).endswith("/data#")


def media_type(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    table = F.create_map(*[F.lit(part) for pair in MEDIA_TYPES for part in pair])
    return F.coalesce(F.try_element_at(table, suffix), F.lit(DEFAULT_MEDIA_TYPE))


def source_catalog(local_path: Column) -> Column:
    name = F.substring_index(F.substring(local_path, 8, 2**31 - 1), "/", 1)
    return F.when(local_path.startswith("source/") & (name != ""), name).otherwise("unknown")


def asset_id(catalog: Column, collection: Column, item_id: Column, asset_key: Column, href: Column) -> Column:
    """Identity of a registered file. It hashes the unsigned link, so a rotating signature changes nothing."""
    blank = F.lit("")
    parts = [F.coalesce(c, blank) for c in (catalog, collection, item_id, asset_key, href)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def packed(digest: Column) -> Column:
    """A SHA-256 in lower-case hex as 33 bytes, any other text as its bytes behind a mark; :func:`unpacked` gives the text back.

    Order is kept among digests and among other texts, which come after them.
    """
    is_digest = (F.length(digest) == 64) & digest.rlike("^[0-9a-f]{64}$")
    return F.when(is_digest, F.concat(F.unhex(F.lit("01")), F.unhex(digest))).otherwise(F.concat(F.unhex(F.lit("FF")), digest.cast("binary")))


def unpacked(value: Column) -> Column:
    rest = F.substring(value, 2, 2**31 - 1)
    return F.when(F.substring(value, 1, 1) == F.unhex(F.lit("01")), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def attempt_id(run_id: Column, collection: Column, item_id: Column, asset_key: Column) -> Column:
    """Identity of a planned transfer; the collection takes part so equal item ids do not collide."""
    return F.sha2(F.concat_ws("\0", run_id, collection, item_id, asset_key), 256)


def product_id(collection: Column) -> Column:
    return F.lower(safe_component(collection))


def preview_key(checksum: Column, byte_size: Column) -> Column:
    size = F.coalesce(F.lower(F.hex(byte_size)), F.lit("unknown"))
    return F.when(
        checksum != "", F.concat(F.substring(checksum, 1, 24), F.lit("-"), size, F.lit("-preview-v1"))
    )


def folder(path: Column) -> Column:
    """Path up to and including its last slash, without a regular expression, which would try every start."""
    return F.left(path, F.length(path) - F.length(F.substring_index(path, "/", -1)))


def parent(path: Column) -> Column:
    """Path of the folder that holds a file; a path without a slash stays as it is."""
    inside = folder(path)
    return F.when(inside == "", path).otherwise(F.left(inside, F.length(inside) - 1))


def path_suffix(name: Column) -> Column:
    """Lower-case extension; a leading dot does not start one."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def is_payload_file(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return (name != "metadata.json") & ~name.rlike(r"^.+\.part$")


def is_junk_file(name: Column) -> Column:
    return name.startswith("._") | (name == ".DS_Store")


def path_error(local_path: Column) -> Column:
    """Why a registry path may not be read as a raster of the source layer; null when it may."""
    blank = F.coalesce(local_path, F.lit("")) == ""
    inside = local_path.startswith("source/") & ~local_path.rlike(r"(^|/)\.\.(/|$)")
    return (
        F.when(blank, F.lit("no local path"))
        .when(~inside, F.lit("outside the source layer"))
        .when(~F.lower(local_path).rlike(r"[^/]\.tiff?$"), F.lit("not a GeoTIFF"))
    )


def row_contains(query: str, columns: list[str], include_keys: bool = False) -> Column:
    """Case-insensitive substring test over a whole row.

    By default each value is searched; ``include_keys`` searches the JSON text of
    the row, in which column names and the word null also match.
    """
    needle = query.lower()
    if include_keys:
        text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
        return F.lower(text).contains(needle)
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.coalesce(F.lower(F.col(name).cast("string")).contains(needle), F.lit(False))
    return hit
