"""URL normalisation, hosts and registrable sites as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scheme, authority, path, query, fragment: RFC 3986, appendix B.
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_IP = r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[?[0-9a-f]*:[0-9a-f:.]*\]?)$"

#: A small part of the Public Suffix List; pass a full one to `site` for production use. `*.` stands for
#: any label, `!` for an exception to it.
SUFFIXES = (
    "com", "org", "net", "edu", "gov", "io", "info", "dev", "app", "blog", "me", "de", "fr", "es", "it", "nl", "eu", "us", "ca", "ch", "at", "se",
    "uk", "co.uk", "org.uk", "ac.uk", "gov.uk", "au", "com.au", "net.au", "org.au", "jp", "co.jp", "ne.jp", "or.jp", "ac.jp", "br", "com.br", "in",
    "co.in", "nz", "co.nz", "za", "co.za", "github.io", "gitlab.io", "blogspot.com", "wordpress.com", "herokuapp.com", "netlify.app", "vercel.app",
    "pages.dev", "*.ck", "!www.ck", "*.kawasaki.jp", "!city.kawasaki.jp",
)


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, PARTS, k)


def authority(scheme: Column, netloc: Column) -> Column:
    """Lower case; without the scheme's own port; a port that isn't a number leaves everything as it is."""
    low = F.lower(netloc)
    user = F.regexp_extract(low, r"^(.*@)?", 1)
    rest = F.regexp_replace(low, r"^.*@", "")
    host = F.regexp_extract(rest, r"^(\[[^\]]*\]|[^:]*)(?::(.*))?$", 1)
    port = F.regexp_extract(rest, r"^(\[[^\]]*\]|[^:]*)(?::(.*))?$", 2)
    number = F.when(port.rlike(r"^[0-9]{1,5}$"), port.cast("int"))
    own = ((scheme == "http") & (number == 80)) | ((scheme == "https") & (number == 443))
    kept = F.when(port == "", F.lit("")).when(own, F.lit("")).otherwise(F.concat(F.lit(":"), number.cast("string")))
    sound = (host != "") & ((port == "") | (number <= 65535))
    return F.when(F.coalesce(sound, F.lit(False)), F.concat(user, host, kept)).otherwise(low)


def normalize_url(url: Column, keep_query: bool = True) -> Column:
    """Lower-case scheme and authority, no default port, trailing slashes, ;parameters or fragment; null becomes empty."""
    text = F.trim(F.coalesce(url, F.lit("")))
    scheme = F.lower(_part(text, 1))
    # the last segment's ;parameters go only where URLs have them; a path keeps its case
    path = F.regexp_replace(_part(text, 3), r";[^/]*$", "")
    path = F.regexp_replace(path, r"/+$", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    netloc = authority(scheme, _part(text, 2))
    query = F.when(F.lit(keep_query) & (_part(text, 4) != ""), F.concat(F.lit("?"), _part(text, 4))).otherwise("")
    head = F.when(scheme == "", F.lit("")).otherwise(F.concat(scheme, F.lit(":")))
    slashes = F.when((_part(text, 2) != "") | text.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"), F.concat(F.lit("//"), netloc)).otherwise("")
    return F.when(text == "", F.lit("")).otherwise(F.concat(head, slashes, path, query))


def normalize_url_for_grouping(url: Column) -> Column:
    """As normalize_url, without the query."""
    return normalize_url(url, keep_query=False)


def host(url: Column) -> Column:
    """Lower-case host of a URL with http(s), without port, user and brackets; else what stands before the first slash."""
    text = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    rest = F.regexp_replace(F.regexp_extract(text, r"^https?://([^/?#]*)", 1), r"^.*@", "")
    named = F.regexp_replace(F.regexp_extract(rest, r"^(\[[^\]]*\]|[^:]*)", 1), r"[\[\]]", "")
    return F.when(text.rlike(r"^https?://"), named).otherwise(F.substring_index(text, "/", 1))


def is_address(name: Column) -> Column:
    """An IP address, or nothing."""
    return (name == "") | name.rlike(_IP)


def bare_host(url: Column) -> Column:
    """host() without dots at its ends."""
    return F.regexp_replace(host(url), r"^\.+|\.+$", "")


def site(url: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """Registrable domain by a suffix list: one label more than the longest suffix; IP addresses and others are themselves.

    A suffix that the list lacks counts as one label, as the list's algorithm has it. A host that is itself a suffix is
    its own site. The list is part of the expression, a pattern: for some hundred suffixes; operators.sites takes a whole list.
    """
    name = bare_host(url)
    exempt = "|".join(re.escape(s[1:]) for s in suffixes if s[0] == "!")
    known = [re.escape(s) for s in suffixes if s[0] not in "*!"] + [rf"[^.]*\.{re.escape(s[2:])}" for s in suffixes if s[0] == "*"]
    suffix = f"(?:{'|'.join(known) or '(?!)'})"
    # the first match is the longest: the name is a suffix, or a label stands before one, or one label before another
    own = F.regexp_extract(name, rf"(?:^{suffix}|(?:^|(?<=\.))[^.]*\.(?:{suffix}|[^.]*)|^[^.]*)\z", 0)
    if exempt:
        spared = F.regexp_extract(name, rf"(?:^|(?<=\.))(?:{exempt})\z", 0)
        own = F.when(spared != "", spared).otherwise(own)
    return F.when(is_address(name), name).otherwise(own)
