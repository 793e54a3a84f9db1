"""URLs as Spark columns: references resolved against a base (RFC 3986), in the spelling of `urls`, its twin in Python.

A URL is a struct of its parts; ok is false for what is none, whose text is kept as it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, trim_col

_PLAIN = "A-Za-z0-9\\-_.~"
_IN_PATH, _IN_FRAGMENT, _IN_HOST = "$&+,/:;=@", "$&+,/:;=?@!()*", "!$&'()*+,;=:\\[\\]<>\""
_PATH_OK = f"^[{_PLAIN}$&+,/:;=@!'()*\\[\\]%]*\\z"
_FRAGMENT_OK = f"^[{_PLAIN}$&+,/:;=?@!'()*\\[\\]%]*\\z"
_BAD_HEX = "%(?![0-9A-Fa-f]{2})"
_SCHEME = "^[A-Za-z][A-Za-z0-9+.\\-]*:"
_USER = f"^[{_PLAIN}:!$&'()*+,;=%@]*\\z"
_HOST = r"^(?:\[[^\]]*\]|[^:\[\]]*)(?::[0-9]*)?\z"
#: A candidate of a srcset: its URL, its size, and what stands before the next.
SRCSET = r"([^ \t\n\r\f]+)([ \t\n\r\f]+[0-9.]+[xw])?([ \t\n\r\f]*(?:,|\z))"


def _struct(**fields: Column) -> Column:
    """A struct with names of its own: aliases get lost within lambda functions of lambda functions."""
    return F.named_struct(*(x for k, c in fields.items() for x in (F.lit(k), c)))


def _encoded(text: Column, kept: str, decode: bool) -> Column:
    """All bytes but those of kept characters as %XX; decode: bytes that are written so count as what they are."""
    plain = f"^[{_PLAIN}{kept}]\\z"

    def one(c: Column) -> Column:
        written = F.concat(F.lit("%"), F.upper(F.substring(c, 2, 2)))
        code = F.conv(F.substring(c, 2, 2), 16, 10).cast("int")
        decoded = F.when((F.length(c) == 3) & (code < 128) & F.char(code).rlike(plain), F.char(code)).otherwise(written)
        other = F.when(c.rlike(plain), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))
        return F.when(F.length(c) == 3, decoded).otherwise(other)

    pieces = "(?s)%[0-9A-Fa-f]{2}|." if decode else "(?s)."
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(pieces), F.lit(0)), one), "")


def _spelled(text: Column, ok: str, kept: str) -> Column:
    return F.when(text.rlike(ok), text).otherwise(_encoded(text, kept, True))


def _path(text: Column) -> Column:
    return _spelled(text, _PATH_OK, _IN_PATH)


def _behind(text: Column, mark: str) -> Column:
    """What stands behind the first mark, null without one."""
    return F.when(F.contains(text, F.lit(mark)), F.regexp_extract(text, f"(?s)\\{mark}(.*)", 1))


def parsed(text: Column) -> Column:
    """ok, scheme, opaque, user, host, authority, path, query and fragment; opaque, user and query may be null."""
    return let(text, _parsed)


def _parsed(text: Column) -> Column:
    rest, fragment = F.substring_index(text, "#", 1), F.coalesce(_behind(text, "#"), F.lit(""))
    has_scheme = rest.rlike(_SCHEME)
    body = F.substring_index(F.regexp_replace(rest, _SCHEME, ""), "?", 1)
    parts = let(_struct(rest=rest, fragment=fragment, has=has_scheme, body=body), _divided)
    bad = text.rlike("[\\x00-\\x1F\\x7F]") | fragment.rlike(_BAD_HEX) | rest.startswith(":")
    return let(parts, lambda p: F.when(bad, p.withField("ok", F.lit(False))).otherwise(p))


def _divided(p: Column) -> Column:
    body = p["body"]
    scheme = F.when(p["has"], F.lower(F.substring_index(p["rest"], ":", 1))).otherwise("")
    query = _behind(F.regexp_replace(p["rest"], _SCHEME, ""), "?")
    from_root = body.startswith("/")
    authority = body.startswith("//") & (p["has"] | ~body.startswith("///"))
    where = F.when(authority, F.regexp_extract(body, "^//([^/]*)", 1)).otherwise("")
    user = F.when(F.contains(where, F.lit("@")), F.regexp_extract(where, "(?s)^(.*)@", 1))
    host = F.substring_index(where, "@", -1)
    path = F.when(authority, F.regexp_replace(body, "^//[^/]*", "")).otherwise(F.when(from_root | ~p["has"], body).otherwise(""))
    colon = ~from_root & ~p["has"] & F.contains(F.substring_index(body, "/", 1), F.lit(":"))
    user_ok = user.isNull() | (user.rlike(_USER) & ~user.rlike(_BAD_HEX))
    host_ok = host.rlike(_HOST) & ~host.rlike(_BAD_HEX) & ~host.rlike('[ "<>^`{}|\\\\]')
    ok = ~colon & user_ok & host_ok & ~path.rlike(_BAD_HEX)
    opaque = F.when(p["has"] & ~from_root, body)
    return _struct(ok=F.coalesce(ok, F.lit(False)), scheme=scheme, opaque=opaque, user=user, host=host, authority=authority, path=path, query=query, fragment=p["fragment"])


def _merged(base: Column, ref: Column) -> Column:
    """The reference's path upon the base's, without . and .. segments."""
    full = F.when(ref == "", base).when(ref.startswith("/"), ref).otherwise(F.concat(F.regexp_extract(base, "(?s)^(.*/)", 1), ref))

    def without_dots(path: Column) -> Column:
        parts = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
        marked = let(parts, lambda all_: F.transform(all_, lambda p, i: _struct(p=p, last=i == F.size(all_) - 1)))

        def step(out: Column, x: Column) -> Column:
            back = F.when(x["p"] == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(out)
            dots = x["p"].isin(".", "..")
            return F.when(dots & ~x["last"], back).otherwise(F.concat(back, F.array(F.when(dots, "").otherwise(x["p"]))))

        return F.concat(F.lit("/"), F.array_join(F.aggregate(marked, F.array().cast("array<string>"), step), "/"))

    return let(full, lambda path: F.when(path == "", "").otherwise(without_dots(path)))


def resolved(base: Column, ref: Column) -> Column:
    """The struct of a reference's struct upon a base's."""
    return let(base, lambda b: let(ref, lambda r: _resolved(b, r)))


def _resolved(base: Column, ref: Column) -> Column:
    own = (ref["scheme"] != "") | (ref["host"] != "") | ref["user"].isNotNull()
    path = F.when(ref["opaque"].isNotNull() | (ref["path"] == ""), ref["path"]).otherwise(_merged(_path(ref["path"]), F.lit("")))
    alone = ref.withField("scheme", F.when(ref["scheme"] != "", ref["scheme"]).otherwise(base["scheme"])).withField("path", path).withField("authority", ref["authority"] | (ref["scheme"] == ""))
    empty = (ref["path"] == "") & ref["query"].isNull()
    query = F.when(empty, base["query"]).otherwise(ref["query"])
    fragment = F.when(empty & (ref["fragment"] == ""), base["fragment"]).otherwise(ref["fragment"])
    upon = base.withField("query", query).withField("fragment", fragment)
    merged = F.when((ref["path"] == "") & base["opaque"].isNotNull(), upon).otherwise(upon.withField("opaque", F.lit(None).cast("string")).withField("path", _merged(_path(base["path"]), _path(ref["path"]))))
    return F.when(own, alone).otherwise(merged)


def written(url: Column) -> Column:
    """A struct's text."""
    return let(url, _written)


def _written(url: Column) -> Column:
    user, host, scheme = url["user"], url["host"], F.when(url["scheme"] != "", F.concat(url["scheme"], F.lit(":"))).otherwise("")
    has = ((scheme != "") | (host != "") | user.isNotNull()) & ((host != "") | (url["path"] != "") | user.isNotNull()) & (url["authority"] | (scheme == ""))
    named = F.when(host.rlike("^[\\x00-\\x7F]*\\z"), host).otherwise(_encoded(host, _IN_HOST, False))
    paths = let(_path(url["path"]), lambda p: F.when((p != "") & ~p.startswith("/") & (host != ""), F.concat(F.lit("/"), p)).otherwise(p))
    front = F.concat(scheme, F.when(has, F.concat(F.lit("//"), F.coalesce(F.concat(user, F.lit("@")), F.lit("")), named)).otherwise(""))
    path = let(paths, lambda p: F.when((front == "") & F.contains(F.substring_index(p, "/", 1), F.lit(":")), F.concat(F.lit("./"), p)).otherwise(p))
    tail = F.concat(F.coalesce(F.concat(F.lit("?"), url["query"]), F.lit("")), F.when(url["fragment"] != "", F.concat(F.lit("#"), _spelled(url["fragment"], _FRAGMENT_OK, _IN_FRAGMENT))).otherwise(""))
    return F.concat(F.when(url["opaque"].isNotNull(), F.concat(scheme, url["opaque"])).otherwise(F.concat(front, path)), tail)


def javascript(uri: Column) -> Column:
    return F.translate(trim_col(uri), "\t\n\r", "").rlike("(?i)^javascript:")
