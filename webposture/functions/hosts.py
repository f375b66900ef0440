"""Host names in the one form that browsers compare: other scripts in Punycode, numeric addresses in full.

Everything is an expression on one column.  The costly branches are taken only for hosts that need them.  Names are lower-cased and
wide forms and dots of other scripts folded; Unicode composition and the rarer mappings of IDNA are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

# The parameters of Punycode for host names (RFC 3492, section 5).
_BASE, _T_MIN, _T_MAX, _SKEW, _DAMP, _BIAS, _FIRST = 36, 1, 26, 38, 700, 72, 128

#: Full-width forms of printable ASCII, and the dots that end a label like a full stop.
_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "\u3002\uff61"
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + ".."
#: Characters that names are compared without.
_IGNORED = r"[\x{AD}\x{200B}\x{2060}\x{FEFF}\x{FE00}-\x{FE0F}]"

_NUMBER = r"(?:[0-9]+|0x[0-9a-f]*)"
#: A host whose last label is a number must be an address.
_ENDS_IN_NUMBER = rf"(?:^|\.){_NUMBER}\.?\z"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digit(value: Column) -> Column:
    """A number below 36 as the letter or digit that stands for it."""
    return F.char(F.when(value < 26, value + 97).otherwise(value + 22))


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    """The bias for the next number (RFC 3492, section 6.1)."""
    start = F.when(first, (delta / _DAMP).cast("long")).otherwise(F.shiftright(delta, 1))
    limit = (_BASE - _T_MIN) * _T_MAX // 2

    def shrink(state: Column, _: Column) -> Column:
        smaller = F.struct((state["delta"] / (_BASE - _T_MIN)).cast("long").alias("delta"), (state["k"] + _BASE).alias("k"))
        return F.when(state["delta"] > limit, smaller).otherwise(state)

    begin = F.struct((start + (start / points).cast("long")).alias("delta"), F.lit(0).alias("k"))
    end = lambda s: (s["k"] + ((_BASE - _T_MIN + 1) * s["delta"] / (s["delta"] + _SKEW)).cast("long")).cast("int")
    # Five divisions take any number of a name of code points below their limit.
    return F.aggregate(F.sequence(F.lit(1), F.lit(6)), begin, shrink, end)


def _written(delta: Column, bias: Column) -> Column:
    """A number in digits of falling weight, the last one below its threshold."""

    def step(state: Column, k: Column) -> Column:
        threshold = F.least(F.greatest(k * _BASE - bias, F.lit(_T_MIN)), F.lit(_T_MAX))
        rest, span = state["rest"] - threshold, F.lit(_BASE) - threshold
        last = F.struct(F.lit(-1).cast("long").alias("rest"), F.concat(state["text"], _digit(state["rest"])).alias("text"))
        more = F.struct((rest / span).cast("long").alias("rest"), F.concat(state["text"], _digit(threshold + F.pmod(rest, span))).alias("text"))
        return F.when(state["rest"] < 0, state).when(state["rest"] < threshold, last).otherwise(more)

    return F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.struct(delta.alias("rest"), F.lit("").alias("text")), step, lambda s: s["text"])


def punycode(label: Column) -> Column:
    """The Punycode of a label (RFC 3492), without a prefix.

    Characters outside ASCII are inserted in the order of their code points, then of their places; each adds a number that
    says how far the decoder's place and code point move on to it.
    """

    def encode(points: Column) -> Column:
        basic = F.filter(points, lambda c: c < _FIRST)
        others = F.sort_array(F.filter(
            F.transform(points, lambda c, i: F.struct(c.alias("point"), i.alias("at"))), lambda x: x["point"] >= _FIRST
        ))

        def insert(state: Column, x: Column) -> Column:
            # The place among what the decoder has by then.
            place = F.size(F.filter(points, lambda c, i: (i < x["at"]) & (c <= x["point"]))).cast("long")
            length = state["length"] + 1
            delta = (x["point"] - state["point"]).cast("long") * length + place - state["place"]
            first = state["length"] == F.size(basic)
            return _let(delta, lambda d: F.struct(
                x["point"].alias("point"), (place + 1).alias("place"), length.alias("length"),
                # The last number is followed by none.
                F.when(length < F.size(points), _adapted(d, length, first)).otherwise(F.lit(_BIAS)).alias("bias"),
                F.concat(state["text"], _written(d, state["bias"])).alias("text"),
            ))

        letters = F.array_join(F.transform(basic, lambda c: F.char(c)), "")
        start = F.struct(
            F.lit(_FIRST).alias("point"), F.lit(0).cast("long").alias("place"), F.size(basic).alias("length"), F.lit(_BIAS).alias("bias"),
            F.when(F.size(basic) > 0, F.concat(letters, F.lit("-"))).otherwise(F.lit("")).alias("text"),
        )
        return F.aggregate(others, start, insert, lambda s: s["text"])

    return _let(F.transform(F.split(label, ""), lambda c: F.ascii(c)), encode)


def ascii_name(host: Column) -> Column:
    """A lower-cased host name with its labels of other scripts in Punycode."""

    def encode(folded: Column) -> Column:
        labels = F.transform(
            F.split(folded, r"\.", -1),
            lambda label: F.when(label.rlike(r"[^\x00-\x7f]"), F.concat(F.lit("xn--"), punycode(label))).otherwise(label),
        )
        return F.array_join(labels, ".")

    folded = F.lower(F.regexp_replace(F.translate(host, _WIDE, _NARROW), _IGNORED, ""))
    return F.when(host.rlike(r"[^\x00-\x7f]"), _let(folded, encode)).otherwise(F.lower(host))


def _number(text: Column) -> Column:
    """A number of an address: octal with a leading 0, hexadecimal with 0x, else decimal; NULL if it is none or exceeds 32 bits."""
    hexa = F.regexp_replace(F.substr(text, F.lit(3)), "^0+", "")
    octal = F.regexp_replace(text, "^0+", "")
    value = (
        F.when(text.rlike(r"^0x[0-9a-f]*\z"), F.when(F.length(hexa) <= 8, F.conv(F.concat(F.lit("0"), hexa), 16, 10)))
        .when(text.rlike(r"^0[0-7]*\z"), F.when(F.length(octal) <= 11, F.conv(F.concat(F.lit("0"), octal), 8, 10)))
        .when(text.rlike(r"^[1-9][0-9]{0,9}\z"), text)
    )
    return value.try_cast("long")


def _ipv4_number(host: Column) -> Column:
    """The 32 bits of an address of one to four numbers, of which the last one fills what is left; NULL if it is none."""

    def combine(values: Column) -> Column:
        n = F.size(values)
        last = F.get(values, n - 1)
        room = F.lit(1).cast("long")
        for k in (3, 2, 1, 0):
            room = F.when(n == 4 - k, F.lit(256 ** (k + 1))).otherwise(room)
        heads = F.slice(values, F.lit(1), n - 1)
        fits = (n <= 4) & F.forall(values, lambda v: v.isNotNull()) & F.forall(heads, lambda v: v <= 255) & (last < room)
        high = F.aggregate(heads, F.lit(0).cast("long"), lambda total, v: total * 256 + v)
        return F.when(fits, high * room + last)

    parts = F.split(F.regexp_replace(host, r"\.\z", ""), r"\.", -1)
    return _let(F.transform(parts, _number), combine)


def _dotted(number: Column) -> Column:
    octets = [F.shiftrightunsigned(number, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.when(number.isNotNull(), F.concat_ws(".", *octets))


def ipv4(host: Column) -> Column:
    """The address in four decimal numbers; NULL if the text is none."""
    return _let(_ipv4_number(host), _dotted)


def ipv6(text: Column) -> Column:
    """An address (without brackets) in its shortest form, the longest run of zeros left out; NULL if the text is none."""
    tail = F.regexp_extract(text, r"([0-9.]*\.[0-9.]*)\z", 1)
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

    def from_tail(number: Column) -> Column:
        groups = [F.lower(F.hex(F.shiftrightunsigned(number, s).bitwiseAND(F.lit(0xFFFF)))) for s in (16, 0)]
        return F.concat(F.regexp_replace(text, r"[0-9.]+\z", ""), groups[0], F.lit(":"), groups[1])

    # A last part in four decimal numbers stands for two groups.
    plain = F.when(tail == "", text).when(tail.rlike(rf"^{octet}(?:\.{octet}){{3}}\z"), _let(_ipv4_number(tail), from_tail))

    def groups(part: Column) -> Column:
        return F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":", -1))

    def expand(halves: Column) -> Column:
        left, right = groups(F.get(halves, F.lit(0))), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
        missing = F.lit(8) - F.size(left) - F.size(right)
        shape = F.when(F.size(halves) == 1, missing == 0).otherwise((F.size(halves) == 2) & (missing >= 1))
        valid = shape & F.forall(F.concat(left, right), lambda g: g.rlike(r"^[0-9a-f]{1,4}\z"))
        filled = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
        return F.when(valid, F.transform(filled, lambda g: F.coalesce(F.nullif(F.regexp_replace(g, "^0+", ""), F.lit("")), F.lit("0"))))

    def shorten(whole: Column) -> Column:
        run = lambda i: F.size(F.filter(F.sequence(i, F.lit(7)), lambda j: F.forall(F.sequence(i, j), lambda k: F.get(whole, k) == "0")))
        # The longest run, the first of equal ones.
        runs = F.array(*[F.when(F.get(whole, F.lit(i)) == "0", F.struct(run(F.lit(i)).alias("length"), F.lit(-i).alias("at"))) for i in range(8)])

        def cut(best: Column) -> Column:
            at = -best["at"]
            before, after = F.slice(whole, F.lit(1), at), F.slice(whole, at + best["length"] + 1, F.lit(8))
            return F.concat(F.array_join(before, ":"), F.lit("::"), F.array_join(after, ":"))

        return _let(F.array_max(runs), lambda best: F.when(best["length"] > 1, cut(best)).otherwise(F.array_join(whole, ":")))

    return _let(_let(F.split(plain, "::", -1), expand), lambda whole: F.when(whole.isNotNull(), shorten(whole)))


def canonical_host(host: Column) -> Column:
    """The host of an http(s) URL as browsers compare it; NULL if a numeric or bracketed host is no address."""

    def finish(name: Column) -> Column:
        inside = F.regexp_extract(name, r"^\[(.*)\]\z", 1)
        return (
            F.when(name.startswith("["), F.concat(F.lit("["), ipv6(inside), F.lit("]")))
            .when(name.rlike(_ENDS_IN_NUMBER), ipv4(name))
            .otherwise(name)
        )

    return _let(ascii_name(host), finish)


def canonical_host_of(name: str) -> Column:
    """``canonical_host`` of the column ``name``.  It is some thousand nodes, so it is built once per name and JVM."""
    return _built(name, id(SparkContext._gateway))


@lru_cache(maxsize=64)
def _built(name: str, gateway: int) -> Column:
    return canonical_host(F.col(name))
