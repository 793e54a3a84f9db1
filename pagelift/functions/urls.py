"""URLs: validity of a page's, and resolution of references against a base (RFC 3986), written back in one spelling.

What cannot be parsed is None; callers keep the original then. A path or fragment stays as it is written if all its
characters may stand there, else it is decoded and encoded anew. Hosts beyond ASCII are percent-encoded.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

_PLAIN = "A-Za-z0-9\\-_.~"
_PATH_OK = re.compile(f"[{_PLAIN}$&+,/:;=@!'()*\\[\\]%]*")
_FRAGMENT_OK = re.compile(f"[{_PLAIN}$&+,/:;=?@!'()*\\[\\]%]*")
_HEX = re.compile("%(?![0-9A-Fa-f]{2})")
_SCHEME = re.compile("([A-Za-z][A-Za-z0-9+.\\-]*):(.*)", re.DOTALL)
_USER = re.compile(f"[{_PLAIN}:!$&'()*+,;=%@]*")
_HOST = re.compile(r"(\[[^\]]*\]|[^:\[\]]*)(:[0-9]*)?")


def _encode(text: str, kept: str) -> str:
    return "".join(chr(b) if b < 128 and re.match(f"[{_PLAIN}{kept}]", chr(b)) else f"%{b:02X}" for b in text.encode("utf-8", "surrogatepass"))


def _spelled(text: str, ok: re.Pattern, kept: str) -> str:
    if ok.fullmatch(text):
        return text
    raw = re.sub("(?:%[0-9A-Fa-f]{2})+", lambda m: bytes.fromhex(m.group().replace("%", "")).decode("utf-8", "surrogateescape"), text)
    return "".join(chr(b) if b < 128 and re.match(f"[{_PLAIN}{kept}]", chr(b)) else f"%{b:02X}" for b in raw.encode("utf-8", "surrogateescape"))


@dataclass(frozen=True)
class Url:
    scheme: str = ""
    opaque: str | None = None
    user: str | None = None
    host: str = ""
    authority: bool = False
    path: str = ""
    query: str | None = None
    fragment: str = ""

    @property
    def hostname(self) -> str:
        return re.sub(":[0-9]*\\Z", "", self.host).strip("[]")

    def __str__(self) -> str:
        out = self.scheme + ":" if self.scheme else ""
        if self.opaque is not None:
            out += self.opaque
        else:
            if (self.scheme or self.host or self.user is not None) and (self.host or self.path or self.user is not None) and (self.authority or not self.scheme):
                out += "//" + (f"{self.user}@" if self.user is not None else "") + (self.host if self.host.isascii() else _encode(self.host, "!$&'()*+,;=:\\[\\]<>\""))
            path = _spelled(self.path, _PATH_OK, "$&+,/:;=@")
            if path and path[0] != "/" and self.host:
                path = "/" + path
            if not out and ":" in path.split("/", 1)[0]:
                path = "./" + path
            out += path
        if self.query is not None:
            out += "?" + self.query
        if self.fragment:
            out += "#" + _spelled(self.fragment, _FRAGMENT_OK, "$&+,/:;=?@!()*")
        return out


def parse(text: str) -> Url | None:
    """A URL or reference, or None if it is none."""
    if any(c < " " or c == "\x7f" for c in text):
        return None
    rest, _, fragment = text.partition("#")
    if _HEX.search(fragment):
        return None
    if rest[:1] == ":":
        return None
    m = _SCHEME.fullmatch(rest)
    scheme, rest = (m.group(1).lower(), m.group(2)) if m else ("", rest)
    body, mark, query_text = rest.partition("?")
    query = query_text if mark else None
    if body[:1] != "/":
        if scheme:
            return Url(scheme, opaque=body, query=query, fragment=fragment) if body or m else None
        if ":" in body.split("/", 1)[0]:
            return None
    user, host, authority = None, "", False
    if body.startswith("//") and (scheme or not body.startswith("///")):
        authority = True
        where, slash, tail = body[2:].partition("/")
        body = slash + tail
        if "@" in where:
            user, _, where = where.rpartition("@")
            if not _USER.fullmatch(user) or _HEX.search(user):
                return None
        m = _HOST.fullmatch(where)
        if m is None or _HEX.search(where) or re.search(r"[ \"<>^`{}|\\]", where):
            return None
        host = where
    if _HEX.search(body):
        return None
    return Url(scheme, None, user, host, authority, body, query, fragment)


def _merge(base: str, ref: str) -> str:
    """The reference's path upon the base's, without . and .. segments."""
    full = base if not ref else ref if ref[0] == "/" else base[: base.rfind("/") + 1] + ref
    if not full:
        return ""
    out: list[str] = []
    parts = full.lstrip("/").split("/") if full.startswith("/") else full.split("/")
    if full.startswith("//"):
        parts = full[1:].split("/")
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == ".":
            if last:
                out.append("")
        elif part == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        else:
            out.append(part)
    return "/" + "/".join(out)


def resolve(base: Url, ref: Url) -> Url:
    if ref.scheme or ref.host or ref.user is not None:
        path = ref.path if ref.opaque is not None or not ref.path else _merge(_spelled(ref.path, _PATH_OK, "$&+,/:;=@"), "")
        return replace(ref, scheme=ref.scheme or base.scheme, path=path, authority=ref.authority or not ref.scheme)
    query, fragment = ref.query, ref.fragment
    if not ref.path and query is None:
        query = base.query
        fragment = fragment or base.fragment
    if not ref.path and base.opaque is not None:
        return replace(base, query=query, fragment=fragment)
    path = _merge(_spelled(base.path, _PATH_OK, "$&+,/:;=@"), _spelled(ref.path, _PATH_OK, "$&+,/:;=@"))
    return Url(base.scheme, None, base.user, base.host, base.authority, path, query, fragment)


def valid_page_url(text: str) -> bool:
    """Whether a page's URL is an absolute http or https URL with a host."""
    if any(c < " " or c == "\x7f" for c in text):
        return False
    m = _SCHEME.fullmatch(text)
    if m is None or m.group(1).lower() not in ("http", "https") or not m.group(2).startswith("//"):
        return False
    # A fragment is no part of a requested URL: its sign belongs to the path.
    url = parse(text.replace("#", "%23"))
    return url is not None and bool(url.hostname)
