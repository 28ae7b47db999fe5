"""Network addresses: inet and cidr values are texts in canonical form, MAC addresses texts of pairs with colons.

Addresses of both families need 128-bit arithmetic, which no built-in function has, so these run as Arrow batches in Python.
"""

from __future__ import annotations

import ipaddress
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .temporal import literal

_ADDRESS = re.compile(r"^(\d{1,3}(\.\d{1,3}){3}|[0-9A-Fa-f]*:[0-9A-Fa-f:.]*)(/\d+)?$")


@lru_cache(1 << 16)
def _iface(x):
    """Parsed once for all functions of a worker that ask for the same text."""
    return ipaddress.ip_interface(x)


def _plain(i) -> str:
    return str(i.ip) if i.network.prefixlen == i.max_prefixlen else str(i)


def _mapped(kind: str, f):
    """A batch function over one or two columns, called once for equal values of a batch; a null or a text that is no address gives null."""

    def one(*args):
        if any(a is None or a != a for a in args):
            return None
        try:
            return f(*args)
        except ValueError:
            return None

    if f.__code__.co_argcount == 1:

        @F.pandas_udf(kind)
        def run(a: pd.Series) -> pd.Series:
            known = {x: one(x) for x in a.unique()}
            return pd.Series([known[x] for x in a], dtype=object)
    else:

        @F.pandas_udf(kind)
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            pairs = list(zip(a, b, strict=True))
            known = {p: one(*p) for p in set(pairs)}
            return pd.Series([known[p] for p in pairs], dtype=object)

    return run


def _inet(x):
    return _plain(_iface(x))


def _cidr(x):
    return str(ipaddress.ip_network(x, strict=True))


def _mac(x):
    digits = re.sub(r"[^0-9a-fA-F]", "", x).lower()
    if len(digits) not in (12, 16):
        raise ValueError(x)
    return ":".join(digits[i : i + 2] for i in range(0, len(digits), 2))


def _mac8(x):
    m = _mac(x).split(":")
    return ":".join(m if len(m) == 8 else m[:3] + ["ff", "fe"] + m[3:])


def _set7(x):
    m = _mac8(x).split(":")
    return ":".join([f"{int(m[0], 16) | 2:02x}", *m[1:]])


def _merge(a, b):
    x, y = _iface(a).network, _iface(b).network
    while not (y.subnet_of(x)):
        x = x.supernet()
    return str(x)


def _abbrev(x):
    net = ipaddress.ip_network(x, strict=True) if "/" in x else None
    if net is None or net.version == 6:
        return _inet(x)
    keep = max(1, -(-net.prefixlen // 8))
    return ".".join(str(net.network_address).split(".")[:keep]) + f"/{net.prefixlen}"


def _bits(op):
    def f(a, b):
        x, y = _iface(a), _iface(b)
        if x.version != y.version:
            raise ValueError("families differ")
        return str(ipaddress.ip_address(op(int(x.ip), int(y.ip)).to_bytes(x.max_prefixlen // 8, "big")))

    return f


def _within(strict: bool):
    def f(a, b):
        x, y = _iface(a).network, _iface(b).network
        return x.version == y.version and x.subnet_of(y) and (not strict or x.prefixlen > y.prefixlen)

    return f


TEXT = {
    "abbrev": _abbrev, "broadcast": lambda x: f"{_iface(x).network.broadcast_address}/{_iface(x).network.prefixlen}" if _iface(x).network.prefixlen < _iface(x).max_prefixlen else _inet(x),
    "host": lambda x: str(_iface(x).ip), "hostmask": lambda x: str(_iface(x).network.hostmask), "netmask": lambda x: str(_iface(x).network.netmask), "network": lambda x: str(_iface(x).network),
    "inet_merge": _merge, "macaddr8_set7bit": _set7, "trunc": lambda x: ":".join(_mac(x).split(":")[:3] + ["00"] * (len(_mac(x).split(":")) - 3)),
}
NUMBER = {"family": lambda x: 4 if _iface(x).version == 4 else 6, "masklen": lambda x: _iface(x).network.prefixlen}


def _apply(kind, f):
    return lambda c, t: _mapped(kind, f)(*c)


def _set_masklen(c, type_of) -> Column:
    return _mapped("string", lambda x, n: _plain(ipaddress.ip_interface(f"{_iface(x).ip}/{int(n)}")))(*c)


FUNCTIONS = {n: _apply("string", f) for n, f in TEXT.items()} | {n: _apply("bigint", f) for n, f in NUMBER.items()} | {"inet_same_family": _apply("boolean", lambda a, b: _iface(a).version == _iface(b).version), "set_masklen": _set_masklen}
PREFIX = {"~": lambda x, t: _mapped("string", lambda a: str(ipaddress.ip_address((int(_iface(a).ip) ^ ((1 << _iface(a).max_prefixlen) - 1)).to_bytes(_iface(a).max_prefixlen // 8, "big"))))(x)}
CASTS = {"inet": lambda x, k: _mapped("string", _inet)(x), "cidr": lambda x, k: _mapped("string", _cidr)(x), "macaddr": lambda x, k: _mapped("string", _mac)(x), "macaddr8": lambda x, k: _mapped("string", _mac8)(x)}
OPERATORS = {
    "<<": ("boolean", _within(True)), "<<=": ("boolean", _within(False)), ">>": ("boolean", lambda a, b: _within(True)(b, a)), ">>=": ("boolean", lambda a, b: _within(False)(b, a)),
    "&&": ("boolean", lambda a, b: _within(False)(a, b) or _within(False)(b, a)), "&": ("string", _bits(lambda x, y: x & y)), "|": ("string", _bits(lambda x, y: x | y)),
}


def _shift(sign: int):
    def f(a, n):
        i = _iface(a)
        return _plain(ipaddress.ip_interface(f"{i.ip + sign * int(n)}/{i.network.prefixlen}"))

    return f


def operator(op, a, b, ta, tb):
    if not isinstance(ta, T.StringType):
        return None
    if isinstance(tb, T.StringType):
        if op in OPERATORS:
            kind, f = OPERATORS[op]
            return _mapped(kind, f)(a, b)
        if op == "-":
            return _mapped("bigint", lambda x, y: int(_iface(x).ip) - int(_iface(y).ip))(a, b)
    # A literal text is not shifted by a number unless it is an address.
    if isinstance(tb, T.IntegralType) and op in ("+", "-") and ("run(" in literal(a) or _ADDRESS.match(literal(a).strip("'"))):
        return _mapped("string", _shift(1 if op == "+" else -1))(a, b)
    return None
