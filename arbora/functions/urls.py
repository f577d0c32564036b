"""URL parts, sort keys, storage and log paths, and validation with error codes.

A URL is read as browsers do: the host in lower case and without user info, a port that is the
scheme's own left out, an empty path as ``/``, a bare ``?`` or ``#`` as none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"

# The greatest length of an entity id, and the characters that none may hold.
MAX_ID = 2048
BAD_CHARACTERS = r"[\x00-\x1F\x7F\u200B-\u200D\uFEFF\u00AD\uFFFD]"


def part(url: Column, k: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query with ``?``, 5 fragment with ``#``."""
    return F.regexp_extract(url, _PARTS, k)


def _authority(url: Column) -> Column:
    return F.regexp_replace(part(url, 2), r"^.*@", "")


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(_authority(url), r":\d*$", ""))


def port(url: Column) -> Column:
    """The port, empty if it is the scheme's own."""
    given, scheme = F.regexp_extract(_authority(url), r":(\d+)$", 1), F.lower(part(url, 1))
    own = ((scheme == "http") & (given == "80")) | ((scheme == "https") & (given == "443"))
    return F.when(own, "").otherwise(given)


def origin(url: Column) -> Column:
    return F.concat(F.lower(part(url, 1)), F.lit("://"), host(url), F.when(port(url) == "", "").otherwise(F.concat(F.lit(":"), port(url))))


def is_url(url: Column) -> Column:
    return F.coalesce((part(url, 1) != "") & (host(url) != ""), F.lit(False))


def is_web_url(url: Column) -> Column:
    return is_url(url) & F.lower(part(url, 1)).isin("http", "https")


def segments(url: Column) -> Column:
    return F.filter(F.split(part(url, 3), "/"), lambda s: s != "")


def namespace(url: Column) -> Column:
    """Origin and ``/``, with the first path segment and ``/`` if there are more; what is no URL stands for itself."""
    first = F.when(F.size(segments(url)) > 1, F.concat(F.get(segments(url), 0), F.lit("/"))).otherwise("")
    return F.when(is_url(url), F.concat(origin(url), F.lit("/"), first)).otherwise(url)


def local_id(url: Column) -> Column:
    """The last path segment; empty after a closing slash."""
    return F.regexp_extract(part(url, 3), r"([^/]*)$", 1)


def resolve(url: Column) -> Column:
    """Struct of namespace (origin), context (all before the last segment) and local_id; null for what is no web URL."""
    path, segs = part(url, 3), segments(url)
    closed = F.endswith(path, F.lit("/")) & (path != "/")
    before = F.array_join(F.slice(segs, 1, F.greatest(F.size(segs) - 1, F.lit(0))), "/")
    context = F.when(closed, F.concat(origin(url), F.regexp_replace(path, "/$", ""))).when(F.size(segs) > 1, F.concat(origin(url), F.lit("/"), before)).otherwise(origin(url))
    return F.when(is_web_url(url), F.struct(origin(url).alias("namespace"), context.alias("context"), local_id(url).alias("local_id")))


def entity_parts(url: Column) -> Column:
    """Struct of protocol, hostname, path segments and local_id; null for what is no web URL."""
    segs = segments(url)
    last = F.coalesce(F.try_element_at(segs, F.lit(-1)), F.lit(""))
    return F.when(is_web_url(url), F.struct(F.lower(part(url, 1)).alias("protocol"), host(url).alias("hostname"), segs.alias("path"), last.alias("local_id")))


def reversed_host(url: Column) -> Column:
    return F.array_join(F.reverse(F.split(host(url), r"\.")), ",")


def _told(text: Column) -> Column:
    return F.when(F.length(text) > 1, text).otherwise("")


def sort_key(url: Column) -> Column:
    """``com,example,:8080,/a,/b,?q,#h``: a key under which a host's pages lie together."""
    usual = port(url).isin("", "80", "443")
    found = F.concat(
        F.array(reversed_host(url), F.when(usual, "").otherwise(F.concat(F.lit(":"), port(url)))),
        F.transform(segments(url), lambda s: F.concat(F.lit("/"), s)), F.array(_told(part(url, 4)), _told(part(url, 5))),
    )
    return F.when(is_url(url), F.array_join(F.filter(found, lambda s: s != ""), ",")).otherwise(F.concat(F.lit("_invalid,"), F.replace(url, F.lit(","), F.lit("%2C"))))


def host_sort_key(url: Column) -> Column:
    return F.when(is_url(url), reversed_host(url)).otherwise("_invalid")


_KEY = r"^([^:/?#]*?)(?:,(:\d+))?((?:,/[^?#]*)?)(?:,(\?[^#]*))?(?:,(#.*))?$"


def key_to_url(key: Column, scheme: str = "https") -> Column:
    """The URL of a sort key, by the scheme given."""
    found = lambda k: F.regexp_extract(key, _KEY, k)
    name = F.array_join(F.reverse(F.split(found(1), ",")), ".")
    path = F.when(found(3) == "", "/").otherwise(F.replace(found(3), F.lit(",/"), F.lit("/")))
    invalid = F.replace(F.substring(key, 10, MAX_ID * 4), F.lit("%2C"), F.lit(","))
    return F.when(F.startswith(key, F.lit("_invalid,")), invalid).otherwise(F.concat(F.lit(f"{scheme}://"), name, found(2), path, found(4), found(5)))


def key_host(key: Column) -> Column:
    """Host segments of a sort key."""
    return F.regexp_replace(F.regexp_extract(key, r"^[^:/?#]*", 0), ",$", "")


def key_domain(key: Column) -> Column:
    """The first two host segments of a sort key."""
    return F.array_join(F.slice(F.split(key_host(key), ","), 1, 2), ",")


def domain(url: Column) -> Column:
    return key_domain(reversed_host(url))


def reversed_host_segments(name: Column) -> Column:
    """``com.a.b`` as ``com,a,b``."""
    return F.replace(name, F.lit("."), F.lit(","))


def storage_path(url: Column) -> Column:
    """``https://a.b.c/x`` as ``.c/.b/.a/x``; port and query go."""
    dotted = F.array_join(F.transform(F.reverse(F.split(host(url), r"\.")), lambda s: F.concat(F.lit("."), s)), "/")
    return F.when(is_web_url(url), F.concat(dotted, F.when(part(url, 3) == "", "/").otherwise(part(url, 3))))


def path_to_url(path: Column) -> Column:
    """The https URL of a storage path."""
    dotted = F.regexp_extract(path, r"^(\.[^/]*(?:/\.[^/]*)*)", 1)
    name = F.array_join(F.reverse(F.transform(F.split(dotted, "/"), lambda s: F.substring(s, 2, MAX_ID))), ".")
    return F.concat(F.lit("https://"), name, F.substr(path, F.length(dotted) + 1))


def namespace_path(url: Column) -> Column:
    """A storage path without a closing slash."""
    return F.regexp_replace(storage_path(url), "/+$", "")


def date_of(ms: Column) -> Column:
    """``yyyy-MM-dd`` of milliseconds, whatever the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int")).cast("string")


def sequence_of(ms: Column) -> Column:
    """``HHmmss-SSS`` of milliseconds."""
    digits = lambda unit, size, width: F.lpad(F.pmod(F.floor(ms / unit), F.lit(size)).cast("string"), width, "0")
    return F.concat(digits(3_600_000, 24, 2), digits(60_000, 60, 2), digits(1000, 60, 2), F.lit("-"), digits(1, 1000, 3))


def log_path(url: Column, ms: Column) -> Column:
    return F.concat(namespace_path(url), F.lit("/_wal/"), date_of(ms), F.lit("/"), sequence_of(ms), F.lit(".gcol"))


def log_path_parts(path: Column) -> Column:
    """Struct of date and sequence of a log path; null for others."""
    found = lambda k: F.regexp_extract(path, r"/_wal/(\d{4}-\d{2}-\d{2})/(\d{6}-\d{3}|\d{3})\.gcol$", k)
    return F.when(found(1) != "", F.struct(found(1).alias("date"), found(2).alias("sequence")))


def knowledge_segments(name: Column) -> Column:
    """Sort key of a knowledge-base id by its first letter."""
    kind = F.when(F.startswith(name, F.lit("Q")), "entity,").when(F.startswith(name, F.lit("P")), "prop,").when(F.startswith(name, F.lit("L")), "lexeme,").otherwise("")
    return F.concat(F.lit("org,wikidata,"), kind, name)


def external_segments(prop: Column, value: Column, sites: dict[str, str]) -> Column:
    """Sort key of an external id by a map of property to site; null for a property that it lacks."""
    site = F.lit(None).cast("string")
    for name, at in sites.items():
        site = F.when(prop == name, F.lit(at)).otherwise(site)
    return F.concat(site, F.lit(","), value)


def entity_id_error(c: Column) -> Column:
    """Why a string is no entity id; null if it is one.  The codes are fixed values."""
    web = c.rlike(r"(?i)^https?:")
    return (
        F.when(c.isNull() | (F.trim(c) == ""), "EMPTY").when(F.length(c) > MAX_ID, "TOO_LONG").when(c.rlike(BAD_CHARACTERS), "INVALID_CHARACTERS")
        .when(~c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (web & ~c.rlike(r"(?i)^https?://([^/?#@]*@)?[^/?#@\s<>^|]+([/?#]|$)")), "INVALID_URL")
        .when(~web, "INVALID_PROTOCOL").when(host(c).isin(".", ".."), "INVALID_HOSTNAME").when(c.rlike(r"^[^/]*//[^/?#]*[^/?#:@][^/?#]*@"), "HAS_USER_INFO")
    )


def is_entity_id(c: Column) -> Column:
    return c.isNotNull() & entity_id_error(c).isNull()


def is_predicate(c: Column) -> Column:
    return c.rlike(r"^[$A-Za-z_][A-Za-z0-9_$]*$")


def is_transaction_id(c: Column) -> Column:
    return c.rlike(r"^[0-9A-HJKMNP-TV-Z]{26}$")


def is_duration(c: Column) -> Column:
    return c.rlike(r"^P(?=[0-9T])(\d+Y)?(\d+M)?(\d+W)?(\d+D)?(T(?=\d)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?$")
