"""URL column expressions (netloc and origin as ``urlparse`` defines them)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ``urlparse(url).netloc``: the text between '//' and the next '/', '?' or
# '#', only when the '//' follows an optional scheme at the very start.  Keeps
# userinfo, port, case and 'www.'; no authority -> ''.
NETLOC_RE = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
PATH_RE = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?(.*)$"


def url_domain(url: Column) -> Column:
    return F.regexp_extract(url, NETLOC_RE, 1)


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME_RE, 1))


def url_origin(url: Column) -> Column:
    """``f"{scheme}://{netloc}"``: the robots-rules cache key."""
    return F.concat(url_scheme(url), F.lit("://"), url_domain(url))


def url_path(url: Column) -> Column:
    """Path + query + fragment after the authority; '' -> '/'."""
    p = F.regexp_extract(url, PATH_RE, 1)
    return F.when(p == "", F.lit("/")).otherwise(p)


def first_path_segment(url: Column) -> Column:
    """First segment of the path ('' when none): used as a folder name."""
    return F.regexp_extract(url_path(url), r"^/([^/?#]*)", 1)
