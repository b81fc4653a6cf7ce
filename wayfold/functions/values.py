"""Scalars: falsy defaults, ids, statuses, page arithmetic, keys of stored objects."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The digits of identifiers and their form.
ID_DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
ID_FORM = "^[0-9A-HJKMNP-TV-Z]{26}$"
#: Error codes that are not plain bad requests (400), by their HTTP status.
HTTP_STATUS = {"StateNotFound": 404, "SpanNotFound": 404, "SandboxGone": 404, "ReplayDivergence": 409, "VmmFailed": 503}


def falsy(value: Column, default: int | str) -> Column:
    """``default`` for null, zero and the empty string."""
    return F.coalesce(F.nullif(value, F.lit("" if isinstance(default, str) else 0)), F.lit(default))


def id_millis(text: Column) -> Column:
    """Milliseconds of an identifier's first ten digits."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(0).cast("long"), lambda a, i: a * 32 + F.instr(F.lit(ID_DIGITS), F.substring(text, i, F.lit(1))) - 1)


def is_id(text: Column) -> Column:
    return text.rlike(ID_FORM)


def new_id(millis: Column) -> Column:
    """A fresh identifier: 48 bits of time, 80 of chance. Not the same when run again: write it once."""
    digits = [F.substring(F.lit(ID_DIGITS), (F.shiftright(millis, 5 * (9 - i)).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for i in range(10)]
    chance = [F.substring(F.lit(ID_DIGITS), (F.rand() * 32).cast("int") + 1, F.lit(1)) for _ in range(16)]
    return F.concat(*digits, *chance)


def http_status(code: Column) -> Column:
    """200 without an error, else the error's status."""
    out = F.when(code.isNull(), 200)
    for name, status in HTTP_STATUS.items():
        out = out.when(code == name, status)
    return out.otherwise(400)


def exec_status(exit_code: Column) -> tuple[Column, Column, Column]:
    """(status, error, message) of a finished command."""
    ok = F.coalesce(exit_code == 0, F.lit(False))
    return F.when(ok, "ok").otherwise("error"), F.when(~ok, "ExecFailed"), F.when(~ok, F.concat(F.lit("exit "), F.coalesce(exit_code.cast("string"), F.lit("None"))))


def exit_code(exited: Column, status: Column, signal: Column) -> Column:
    """What a shell reports: the status, 128 and the signal, else 1."""
    return F.when(exited, status).when(signal.isNotNull(), 128 + signal).otherwise(1)


def n_blocks(size: Column, block: int) -> Column:
    return F.floor((size + block - 1) / block).cast("long")


def page_of(address: Column, base: Column, offset: Column, page_size: Column) -> Column:
    """The page that holds an address of a region: aligned down, moved into the file, counted in pages."""
    return F.floor((offset + address.bitwiseAND(-page_size) - base) / page_size).cast("long")


def fixed_width(data: Column, width: int) -> Column:
    """Bytes cut or filled up with zeros to ``width``."""
    return F.rpad(F.substring(data, 1, width), width, F.lit(b"\x00"))


def _ten(n: Column) -> Column:
    """10**n for n from 0 to 20, as a decimal."""
    return F.element_at(F.array(*[F.lit(Decimal(10) ** i).cast("decimal(38,0)") for i in range(21)]), n.cast("int") + 1)


def _two(n: Column) -> Column:
    """2**n for n from 0 to 120, as a decimal."""
    power = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k).cast("decimal(20,0)")
    low = F.least(n, F.lit(60)).cast("int")
    return (power(low) * power((n - low).cast("int"))).cast("decimal(38,0)")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scaled(value: Column, places: Column) -> Column:
    """The whole number nearest to ``value`` * 10**``places``, the even one of two, as a decimal; values from 2**-49 to 2**53, places from -10 to 20.

    Doubles tell it where their product, which is off by 2**-53 of itself at most, is further than that from a half. Elsewhere a double is a whole number times a
    power of two; so is taken apart, and the division is one of whole numbers.
    """

    def exactly(value: Column, places: Column) -> Column:
        k = F.least(F.greatest(53 - F.floor(F.log2(value)), F.lit(0)), F.lit(110)).cast("int")
        return bound(bound(F.struct(value.alias("v"), places.alias("p"), k.alias("k")), ratio), divided)

    def ratio(x: Column) -> Column:
        whole = (x["v"] * F.pow(F.lit(2.0), x["k"])).cast("long").cast("decimal(18,0)")
        over, under = whole * _ten(F.greatest(x["p"], F.lit(0))), _two(x["k"]) * _ten(F.greatest(-x["p"], F.lit(0)))
        return F.struct(over.cast("decimal(38,0)").alias("over"), under.cast("decimal(38,0)").alias("under"))

    def divided(x: Column) -> Column:
        rest = x["over"] % x["under"]
        return bound(F.struct(x["under"].alias("under"), rest.alias("rest"), ((x["over"] - rest) / x["under"]).cast("decimal(37,0)").alias("down")), nearest)

    def nearest(x: Column) -> Column:
        gap = x["under"] - x["rest"]
        return x["down"] + F.when((x["rest"] > gap) | ((x["rest"] == gap) & (x["down"] % 2 == 1)), 1).otherwise(0)

    # Powers of ten up to 10**22 are doubles, and come exact.
    ten = F.pow(F.lit(10.0), F.abs(places).cast("double"))
    product = F.struct(F.when(places < 0, value / ten).otherwise(value * ten).alias("q"), value.alias("v"), places.cast("int").alias("p"))
    clear = lambda x: (x["q"] < 2.0**50) & (F.abs(x["q"] - F.floor(x["q"]) - 0.5) > x["q"] * 2.0**-52)
    return bound(product, lambda x: F.when(clear(x), F.rint(x["q"]).cast("long").cast("decimal(38,0)")).otherwise(exactly(x["v"], x["p"]).cast("decimal(38,0)")))


#: Below it a number rounds to 0.0000; from it on doubles are whole; below ``PLAIN`` four places are at most 15 digits, which tell doubles apart.
LEAST, WHOLE, PLAIN = 2.0**-49, 2.0**53, 1e11


def rounded(value: Column, places: int = 4) -> Column:
    """A double that is not whole, to so many places (four at most), as the shortest text of the nearest double: rounded by its exact value, half to even."""
    size = F.least(F.greatest(F.abs(value), F.lit(LEAST)), F.lit(WHOLE))
    text = lambda v, n: (scaled(v, F.lit(n)) * F.lit(Decimal(1).scaleb(-n)).cast(f"decimal({n + 1},{n})")).cast(f"decimal(38,{n})").cast("string")
    # With more digits than a double tells apart, the fewest places that give the same double.
    short = lambda v, best: F.coalesce(*[bound(text(v, n), lambda t: F.when(t.cast("double") == best.cast("double"), t)) for n in range(1, places)], best)
    found = bound(size, lambda v: bound(text(v, places), lambda best: F.when(v < PLAIN, best).otherwise(short(best.cast("double"), best))))
    return F.concat(F.when(value < 0, "-").otherwise(""), F.regexp_replace(found, "([.][0-9]+?)0+$", "$1"))


def general(value: Column) -> Column:
    """A number of up to six significant digits, without zeros at the end, with an exponent below -4 and from 6 on: rounded by its exact
    value, half to even. Null for what is smaller than 2**-49 but not 0, or is 2**53 or more."""
    # Out of these bounds the number is not looked at, but Spark may compute it.
    size = F.least(F.greatest(F.abs(value), F.lit(LEAST)), F.lit(WHOLE))
    strip = lambda t: F.regexp_replace(t, "[.]?0+$", "")

    def shown(x: Column) -> Column:
        # Rounding up may give a seventh digit.
        power = x["power"] + F.when(x["digits"] >= 1_000_000, 1).otherwise(0)
        digits = F.when(x["digits"] >= 1_000_000, 100_000).otherwise(x["digits"]).cast("long").cast("string")
        return bound(F.struct(power.alias("power"), digits.alias("digits")), text)

    def text(x: Column) -> Column:
        power, digits = x["power"], x["digits"]
        fixed = F.when(power >= 0, F.concat(F.left(digits, power + 1), F.lit("."), F.substring(digits, power + 2, F.lit(9)), F.lit("0"))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
        exponent = F.concat(F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
        return F.when(power.between(-4, 5), strip(fixed)).otherwise(F.concat(strip(F.concat(F.left(digits, F.lit(1)), F.lit("."), F.substring(digits, 2, 9))), exponent))

    number = bound(F.struct(size.alias("v"), F.floor(F.log10(size)).cast("int").alias("power")), lambda x: bound(F.struct(x["power"].alias("power"), scaled(x["v"], 5 - x["power"]).alias("digits")), shown))
    known = F.when((F.abs(value) >= LEAST) & (F.abs(value) < WHOLE), F.concat(F.when(value < 0, "-").otherwise(""), number))
    return F.when(value == 0, "0").otherwise(known)


def budget_snapshot(counters: Column) -> Column:
    """Canonical JSON of named counters: whole ones as integers, others to four places. Null for null."""
    by_name = F.array_sort(F.map_entries(counters))
    # Doubles come as text with an exponent beyond seven digits; decimals never do.
    whole = lambda v: F.when(F.abs(v) < 1e18, v.cast("long").cast("string")).otherwise(v.cast("decimal(38,0)").cast("string"))
    number = lambda v: F.when(v == F.rint(v), whole(v)).otherwise(rounded(v))
    return F.concat(F.lit("{"), F.array_join(F.transform(by_name, lambda e: F.concat(json_string(e["key"]), F.lit(":"), number(e["value"]))), ","), F.lit("}"))


def json_string(text: Column) -> Column:
    """A string as JSON: what stands between the brackets of the array of it alone."""
    quoted = F.to_json(F.array(text))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def decoded(data: Column) -> Column:
    """Bytes as UTF-8, with U+FFFD for what is not."""
    return F.make_valid_utf8(data.cast("string"))


def event_uri(run_id: Column, span_id: Column, t: Column) -> Column:
    return F.concat(F.lit("runs/"), run_id, F.lit("/spans/"), span_id, F.lit("/events/"), F.format_string("%08d", t), F.lit(".json"))


def snapshot_uri(state_id: Column) -> Column:
    return F.concat(F.lit("snapshots/"), state_id)


def prompt_uri(run_id: Column, state_id: Column) -> Column:
    return F.concat(F.lit("runs/"), run_id, F.lit("/prompts/"), state_id, F.lit(".json"))
