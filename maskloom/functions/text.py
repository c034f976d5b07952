"""Native scalar expressions: keyed tokens, patterns, lists. No Python runs on executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the sentinel format: brackets, separator, body alphabet and length.
OPEN, CLOSE, MIDDLE = "⟦", "⟧", "·"
BASE32 = "abcdefghijklmnopqrstuvwxyz234567"
BODY = 26
SENTINEL = f"{OPEN}[^{CLOSE}]*{CLOSE}"
WELL_FORMED = f"^{OPEN}[a-z2-7]{{26}}{MIDDLE}[A-Z]+{CLOSE}$"

# Kinds and their sentinel tags. Quasi-identifiers become a class label instead.
TAGS = {"Email": "EM", "PhoneSn": "PH", "CniSn": "CN", "nom_sn": "NM", "Person": "PE", "Location": "LO"}
QUASI = ["Ip", "Date", "CreditCard"]
# Kinds of places, which an explicit generalisation policy makes labels, too.
PLACES = ["ville_sn", "Location"]

_LOCAL = "[A-Za-z0-9._%+-]"
# A domain has 127 labels at most.
_AT_DOMAIN = r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,}"
#: Alternatives in order of priority. ASCII classes only, as engines differ on others. A local part is
#: tried once, where its run of characters begins or an address (the only match that ends in a letter)
#: has just ended, so that a text costs one pass, however long its runs are.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G(?<=[A-Za-z])){_LOCAL}++{_AT_DOMAIN}",
    "date": r"[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])",
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "phone": r"\+[0-9][0-9 ()-]{6,17}[0-9]",
    "digits": r"[0-9]{13,19}",
}
#: Which detector names each alternative serves; an unknown name is an error when the plan is made.
DETECTORS = {"Email": "email", "Date": "date", "Ip": "ip", "PhoneSn": "phone", "CniSn": "digits", "CreditCard": "digits"}


#: The same for engines without look-behind, which are linear in any case.
PLAIN_EMAIL = f"{_LOCAL}+{_AT_DOMAIN}"


def pattern(disabled: list[str] | None = None, plain: bool = False) -> str:
    """The alternation of all detectors that are not disabled; ``plain``: without look-behind."""
    off = set(disabled or [])
    if unknown := off - DETECTORS.keys():
        raise ValueError(f"unknown detectors: {sorted(unknown)}")
    known = PATTERNS | {"email": PLAIN_EMAIL} if plain else PATTERNS
    on = [p for name, p in known.items() if any(d not in off and DETECTORS[d] == name for d in DETECTORS)]
    return "|".join(on) if on else "a^"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; an expression used within a lambda is otherwise computed for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def running(lengths: Column, step: int = 256) -> Column:
    """The sums of the array's numbers before each of them, in two levels, so that long arrays stay cheap."""
    none = F.array().cast("array<bigint>")

    def sums(xs: Column) -> Column:
        def upto(at: Column, n: Column) -> Column:
            return F.aggregate(F.slice(xs, at + 1, n), F.lit(0).cast("long"), lambda total, x: total + x)

        last = F.floor((F.size(xs) - 1) / step).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: upto(F.lit(0), b * step))
        return F.when(F.size(xs) > 0, let(blocks, lambda bs: F.transform(xs, lambda _, i: F.get(bs, F.floor(i / step).cast("int")) + upto(i - i % step, i % step)))).otherwise(none)

    return let(lengths, sums)


def placed(text: Column, regex: str) -> Column:
    """Array of (value, start, byte_start) of all matches: places are sums of the lengths before them, never searched for.

    Null where there is none.
    """
    t = F.coalesce(text, F.lit(""))
    pieces = F.struct(F.regexp_extract_all(t, F.lit(regex), F.lit(0)).alias("m"), F.split(t, regex, -1).alias("s"))

    def sizes(x: Column, of) -> Column:
        return F.transform(x["m"], lambda m, i: of(m) + of(F.get(x["s"], i)))

    def places(x: Column) -> Column:
        both = F.arrays_zip(x["m"].alias("m"), F.slice(x["s"], F.lit(1), F.size(x["m"])).alias("s"), running(sizes(x, F.length)).alias("c"), running(sizes(x, F.octet_length)).alias("b"))
        return F.transform(both, lambda e: F.struct(e["m"].alias("value"), (e["c"] + F.length(e["s"])).alias("start"), (e["b"] + F.octet_length(e["s"])).alias("byte_start")))

    return let(pieces, lambda x: F.when(F.size(x["m"]) > 0, places(x)))


def kind_of(value: Column, disabled: list[str] | None = None) -> Column:
    """Kind of a match, null where validation fails: digit runs must satisfy Luhn; 13 of them from 1 are a CNI."""
    luhn = F.call_function("luhn_check", value)
    digits = F.when(~luhn, None).when((F.length(value) == 13) & value.startswith("1"), "CniSn").otherwise("CreditCard")
    kind = F.when(value.contains("@"), "Email").when(value.startswith("+"), "PhoneSn").when(value.contains("."), "Ip").when(value.contains("-"), "Date").otherwise(digits)
    return F.when(kind.isin(*disabled), None).otherwise(kind) if disabled else kind


def pads(spark: SparkSession, key: bytes) -> DataFrame:
    """One row with the key's inner and outer HMAC pads, so that the key is no literal of a plan."""
    if len(key) > 64:
        raise ValueError("a key has at most 64 bytes")
    block = key.ljust(64, b"\0")
    row = (bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block))
    return spark.createDataFrame([row], "ipad binary, opad binary")


def hmac_hex(message: Column, ipad: Column, opad: Column) -> Column:
    inner = F.unhex(F.sha2(F.concat(ipad, message.cast("binary")), 256))
    return F.sha2(F.concat(opad, inner), 256)


def base32(hexed: Column) -> Column:
    """The first BODY 5-bit groups of a hex string."""

    def nibble(at: Column) -> Column:
        return F.instr(F.lit("0123456789abcdef"), F.substr(hexed, at, F.lit(1))) - 1

    def letter(i: Column) -> Column:
        at = F.floor(i * 5 / 4).cast("int")
        shift = F.element_at(F.array(*[F.lit(8 >> k) for k in range(4)]), (i * 5 % 4 + 1).cast("int"))
        value = F.floor((nibble(at + 1) * 16 + nibble(at + 2)) / shift).cast("int") % 32
        return F.substr(F.lit(BASE32), value + 1, F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BODY - 1)), letter), "")


def tag_of(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(t)) for k, t in TAGS.items()], F.lit("XX"))


def sentinel(kind: Column, value: Column, ipad: Column, opad: Column) -> Column:
    """Deterministic token of a value: its body is the keyed digest, so a body can be checked by recomputing it."""
    body = base32(hmac_hex(F.concat_ws("\x1f", kind, value), ipad, opad))
    return F.concat(F.lit(OPEN), body, F.lit(MIDDLE), tag_of(kind), F.lit(CLOSE))


# Made-up names for fakes.
GIVEN = ["Awa", "Bineta", "Cheikh", "Demba", "Fatou", "Ibra", "Khady", "Lamine"]
FAMILY = ["Ba", "Cisse", "Diallo", "Faye", "Gueye", "Ndiaye", "Sarr", "Sow"]


def fake(kind: Column, value: Column, ipad: Column, opad: Column) -> Column:
    """A realistic stand-in, the same for the same value under one key, with no way back; null for kinds that have none."""
    h = hmac_hex(F.concat_ws("\x1f", F.lit("fake"), kind, value), ipad, opad)

    def pick(names: list[str], at: int) -> Column:
        return F.element_at(F.array(*[F.lit(n) for n in names]), ((F.instr(F.lit("0123456789abcdef"), F.substr(h, F.lit(at), F.lit(1))) - 1) % len(names) + 1).cast("int"))

    digits = F.translate(F.substr(h, F.lit(1), F.lit(7)), "abcdef", "012345")
    person = F.concat(pick(GIVEN, 1), F.lit(" "), pick(FAMILY, 2))
    return (
        F.when(kind == "Email", F.concat(F.lit("user."), F.substr(h, F.lit(1), F.lit(8)), F.lit("@example.org")))
        .when(kind == "PhoneSn", F.concat(F.lit("+221 70"), digits))
        .when(kind == "Person", person)
        .when(kind == "nom_sn", pick(FAMILY, 2))
    )


def label(kind: Column) -> Column:
    return F.concat(F.lit("["), F.upper(kind), F.lit("]"))


def base64url(text: Column) -> Column:
    """Without padding."""
    return F.rtrim(F.translate(F.base64(text.cast("binary")), "+/", "-_"), F.lit("="))
