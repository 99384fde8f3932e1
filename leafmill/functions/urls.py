"""URLs, hosts and addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import rx

Column = F.Column

# Query parameters that only track, as prefixes of the name in any case.
TRACKING = r"(?i)^(utm_|fbclid|gclid|mc_cid|mc_eid|ref_|cmpid)"
# Hosts of one page archive, its own host first where a link names one.
ARCHIVE_HOSTS = ["archive.ph", "archive.today", "archive.is", "archive.li", "archive.vn", "archive.fo", "archive.md"]
HOSTNAME = r"^[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)+$"
URL = r"^(?i)(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def part(url: Column, n: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query with its mark, 5 fragment with its mark."""
    return F.regexp_extract(url, URL, n)


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), "^.*@", ""), r":\d*$", ""))


def host_label(url: Column) -> Column:
    """The host without www., null for what is no web address."""
    return F.nullif(F.regexp_replace(host(url), r"^www\.", ""), F.lit(""))


def is_web(url: Column) -> Column:
    return F.coalesce(url.rlike("^(?i)https?://[^/?#]"), F.lit(False))


def embedded_url(url: Column) -> Column:
    """The first absolute URL in the path of an archive's link, decoded; null elsewhere or where there is none."""
    rest = F.concat(part(url, 3), part(url, 4), part(url, 5))
    raw = F.regexp_extract(rest, r"(?i)(?:^|/)(https?:(?://|%2f%2f).+)$", 1)
    decoded = F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    return F.when(F.regexp_replace(host(url), r"^www\.", "").isin(ARCHIVE_HOSTS) & (raw != ""), decoded)


def normalise(text: Column) -> Column:
    """An address as the library files it: https by default, an archived original unwrapped, tracking parameters and the
    fragment gone, scheme and host in lower case, a path of at least '/'. Null for what is empty or no web address."""
    trimmed = F.regexp_replace(text, rx.TRIM, "")
    whole = F.when(trimmed.rlike("^(?i)https?://"), trimmed).otherwise(F.concat(F.lit("https://"), trimmed))
    url = F.coalesce(embedded_url(whole), whole)
    query = F.regexp_replace(part(url, 4), r"^\?", "")
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    clean = F.filter(pairs, lambda p: ~p.rlike(TRACKING))
    kept = F.when(F.size(clean) == F.size(pairs), part(url, 4)).when(F.size(clean) == 0, F.lit("")).otherwise(F.concat(F.lit("?"), F.array_join(clean, "&")))
    kept = F.when(kept == "?", F.lit("?")).otherwise(kept)
    path = F.when(part(url, 3) == "", F.lit("/")).otherwise(part(url, 3))
    scheme = F.lower(part(url, 1))
    authority = F.regexp_replace(F.lower(part(url, 2)), F.when(scheme == "http", F.lit(":80$")).otherwise(F.lit(":443$")), F.lit(""))
    return F.when((trimmed != "") & is_web(url), F.concat(scheme, F.lit("://"), authority, path, kept))


def mirrors(url: Column, hosts: list[str] = ARCHIVE_HOSTS) -> Column:
    """A snapshot's address at every mirror, its own host first."""
    own = host(url)
    names = F.concat(F.array(own), F.filter(F.array(*map(F.lit, hosts)), lambda h: h != own))
    return F.transform(names, lambda h: F.concat(F.lit("https://"), h, part(url, 3), part(url, 4)))


def title_from_path(url: Column) -> Column:
    """A name for a file by the last part of its path, or the address itself."""
    last = F.try_element_at(F.filter(F.split(part(url, 3), "/"), lambda p: p != ""), F.lit(-1))
    name = F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), F.lit("")), r"(?i)\.pdf$", "")
    name = F.trim(F.regexp_replace(F.regexp_replace(name, "[_+-]+", " "), rx.SPACES, " "))
    return F.when(name == "", url).otherwise(name)


def is_pdf(url: Column) -> Column:
    return F.lower(part(url, 3)).endswith(".pdf")


def valid_host(name: Column) -> Column:
    """A plain host name of two labels or more, and nothing else."""
    return F.coalesce((F.length(name) <= 253) & name.rlike(HOSTNAME), F.lit(False))


def is_private(address: Column) -> Column:
    """Whether an address is private, reserved or no address at all."""
    value = F.split_part(F.lower(F.coalesce(address, F.lit(""))), F.lit("%"), F.lit(1))
    v4 = value.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$")
    p = F.split(value, r"\.")
    a, b, c = (F.try_element_at(p, F.lit(i)).try_cast("int") for i in (1, 2, 3))
    # fixed values: the blocks of IANA's special-purpose registries
    private4 = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
        | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 192) & (b == 88) & (c == 99)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    )
    v6 = value.rlike(r"^[0-9a-f:.]*:[0-9a-f:.]*$") & (F.length(value) >= 2)
    private6 = value.isin("::", "::1") | value.rlike("^(?:::ffff:|fc|fd|fe[89ab]|ff|64:ff9b:|2001:0:|2001:db8:|2002:)")
    return F.when(v4, private4).when(v6, private6).otherwise(F.lit(True))


def raw_snapshot(url: Column) -> Column:
    """A snapshot's address in the form that serves the capture as it was taken."""
    return F.regexp_replace(F.regexp_replace(url, "^http:", "https:"), r"/web/(\d+)/", "/web/$1id_/")


def is_challenge(status: Column, html: Column) -> Column:
    """A page that asks for a proof of humanity instead of an archived one."""
    titled = F.substring(F.coalesce(html, F.lit("")), 1, 4000).rlike(r"(?i)<title>\s*archive\.[a-z]{2,6}\s*</title>")
    return F.coalesce(status.isin(429, 403, 503), F.lit(False)) | titled


def mementos(timemap: Column) -> Column:
    """Entries (url, rel, at) of a link-format list whose relation names a memento."""
    entry = r'<([^>]+)>\s*;\s*rel="([^"]*)"(?:\s*;\s*datetime="([^"]*)")?'
    each = F.regexp_extract_all(timemap, F.lit(entry), F.lit(0))
    rows = F.transform(
        each,
        lambda e: F.struct(
            F.regexp_replace(F.regexp_extract(e, entry, 1), "(?i)^http:", "https:").alias("url"),
            F.regexp_extract(e, entry, 2).alias("rel"),
            F.coalesce(F.try_to_timestamp(F.nullif(F.regexp_replace(F.regexp_extract(e, entry, 3), r"^\w+, | GMT$", ""), F.lit("")), F.lit("dd MMM yyyy HH:mm:ss")), F.lit("1970-01-01").cast("timestamp")).alias("at"),
        ),
    )
    return F.filter(rows, lambda r: F.contains(r["rel"], F.lit("memento")))


def newest_memento(entries: Column) -> Column:
    """The first entry marked last, else the newest, the earlier of equals."""
    last = F.filter(entries, lambda e: e["rel"].rlike(r"(?<![A-Za-z0-9_])last(?![A-Za-z0-9_])"))
    ordered = F.array_sort(F.transform(entries, lambda e, i: F.struct((-F.unix_seconds(e["at"])).alias("o"), i.alias("i"), e["url"].alias("url"))))
    return F.coalesce(F.try_element_at(last, F.lit(1))["url"], F.try_element_at(ordered, F.lit(1))["url"])


def byte_range(header: Column, length: Column) -> Column:
    """struct(type, start, end) of a Range header over a body: none, range (inclusive, clamped) or unsatisfiable."""
    spec = F.regexp_extract(header, r"(?i)^\s*bytes\s*=\s*(.+)$", 1)
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")
    one = F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(""))
    form = r"^(\d*)\s*-\s*(\d*)$"
    first, last = F.regexp_extract(one, form, 1), F.regexp_extract(one, form, 2)
    start, stop = first.try_cast("long"), last.try_cast("long")

    def made(kind: str, a: Column, b: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), a.cast("long").alias("start"), b.cast("long").alias("end"))

    nothing = F.lit(None)
    end = F.when(last == "", length - 1).otherwise(F.least(stop, length - 1))
    return (
        F.when(header.isNull() | (spec == "") | (F.size(parts) != 1) | ~one.rlike(form) | ((first == "") & (last == "")), made("none", nothing, nothing))
        .when((first == "") & (stop.isNull() | (stop == 0) | (length == 0)), made("unsatisfiable", nothing, nothing))
        .when(first == "", made("range", F.greatest(F.lit(0), length - stop), length - 1))
        .when(start.isNull() | ((last != "") & (stop.isNull() | (stop < start))), made("none", nothing, nothing))
        .when(start >= length, made("unsatisfiable", nothing, nothing))
        .otherwise(made("range", start, end))
    )


def image_type(content: Column) -> Column:
    """What a file is by its first bytes, null for no known picture or under 12 bytes."""
    head = F.hex(F.substring(content, 1, 12))
    brand = F.substring(head, 17, 8)
    # fixed values: signatures of the formats; the brands are heic heix hevc mif1 msf1 heim heis
    heic = [F.hex(F.lit(b)) for b in ("heic", "heix", "hevc", "mif1", "msf1", "heim", "heis")]
    return F.when(
        F.octet_length(content) >= 12,
        F.when(head.startswith("89504E47"), F.lit("image/png")).when(head.startswith("FFD8FF"), F.lit("image/jpeg")).when(head.startswith("47494638"), F.lit("image/gif"))
        .when(head.startswith("52494646") & (brand == "57454250"), F.lit("image/webp")).when((F.substring(head, 9, 8) == "66747970") & brand.isin(*heic), F.lit("image/heic")),
    )


def is_pdf_bytes(content: Column) -> Column:
    """Whether %PDF- stands first, after white space, in the first 1024 bytes."""
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    return F.coalesce(F.regexp_replace(head, "^[ \\t\\n\\x0B\\f\\r ]+", "").startswith("%PDF-"), F.lit(False))
