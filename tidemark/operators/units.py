"""Problem 3: quantities recorded in different units, brought to common ones.

Method. Every stated number becomes a statement with the units it can have: one if the unit is plain, several if the
symbol has several meanings (a gallon may be US or imperial, a ton metric, short or long). Statements of one record are
tied by physical identities: the same quantity said twice ("141 PS (104 kW)"), power = torque x angular speed,
power = pressure x flow, mass = density x volume. The combination of units with the least log residual over the
identities that hold within ``tolerance`` is chosen; statements whose other readings do as well are flagged not unique
and keep the usual meaning (US gallons and quarts, metric tons, mechanical horsepower). A number with no unit anywhere is
given a unit only by such an identity, and its source is then 'inferred'.

A unit may stand with the number, once for several numbers (a heading, a table column, a note), or in a spec key. Both
ends of a range count. Order codes are no statements. Symbols that a wrong decoding broke and unit words with misread
letters are read as what they were.

Null texts, maps, keys and values give no statements; so does an empty record. Repeated statements of a record come out
once. Texts are read whole.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Unit -> (quantity, factor to the common unit, offset added before the factor). The first of several
# meanings is the usual one.
HP, PS, KGF, LB, IN, GAL = 0.745699872, 0.73549875, 9.80665, 0.45359237, 25.4, 3.785411784
PSI = LB * KGF / (0.0254**2) / 1000
UNITS: dict[str, tuple[str, float, float]] = {
    "°C": ("temperature", 1.0, 0.0),
    "°F": ("temperature", 5 / 9, -32.0),
    "K": ("temperature", 1.0, -273.15),
    "kPa": ("pressure", 1.0, 0.0),
    "Pa": ("pressure", 0.001, 0.0),
    "MPa": ("pressure", 1000.0, 0.0),
    "bar": ("pressure", 100.0, 0.0),
    "mbar": ("pressure", 0.1, 0.0),
    "psi": ("pressure", PSI, 0.0),
    "kgf/cm²": ("pressure", KGF * 10, 0.0),
    "N·m": ("torque", 1.0, 0.0),
    "kN·m": ("torque", 1000.0, 0.0),
    "kgf·m": ("torque", KGF, 0.0),
    "lbf·ft": ("torque", LB * KGF * 0.3048, 0.0),
    "lbf·in": ("torque", LB * KGF * 0.0254, 0.0),
    "mm": ("length", 1.0, 0.0),
    "cm": ("length", 10.0, 0.0),
    "m": ("length", 1000.0, 0.0),
    "in": ("length", IN, 0.0),
    "ft": ("length", IN * 12, 0.0),
    "L/min": ("flow", 1.0, 0.0),
    "L/s": ("flow", 60.0, 0.0),
    "L/h": ("flow", 1 / 60, 0.0),
    "m³/h": ("flow", 1000 / 60, 0.0),
    "gpm": ("flow", GAL, 0.0),
    "gpm (imp)": ("flow", 4.54609, 0.0),
    "kW": ("power", 1.0, 0.0),
    "W": ("power", 0.001, 0.0),
    "MW": ("power", 1000.0, 0.0),
    "hp": ("power", HP, 0.0),
    "PS": ("power", PS, 0.0),
    "L": ("volume", 1.0, 0.0),
    "mL": ("volume", 0.001, 0.0),
    "m³": ("volume", 1000.0, 0.0),
    "gal": ("volume", GAL, 0.0),
    "gal (imp)": ("volume", 4.54609, 0.0),
    "qt": ("volume", GAL / 4, 0.0),
    "qt (imp)": ("volume", 4.54609 / 4, 0.0),
    "kg": ("mass", 1.0, 0.0),
    "g": ("mass", 0.001, 0.0),
    "t": ("mass", 1000.0, 0.0),
    "short ton": ("mass", LB * 2000, 0.0),
    "long ton": ("mass", LB * 2240, 0.0),
    "lb": ("mass", LB, 0.0),
}
COMMON = {"temperature": "°C", "pressure": "kPa", "torque": "N·m", "length": "mm", "flow": "L/min", "power": "kW", "volume": "L", "mass": "kg"}
# How each unit is written. Letter case counts only where two units differ by it.
SPELLINGS: dict[str, str] = {
    "°C": "°C|deg C|deg. C|degrees C|degrees Celsius|Celsius|degC|centigrade",
    "°F": "°F|deg F|deg. F|degrees F|degrees Fahrenheit|Fahrenheit|degF",
    "K": "K|kelvin|°K|kelvins",
    "kPa": "kPa",
    "Pa": "Pa",
    "MPa": "MPa",
    "bar": "bar|bars|barg|bar(g)",
    "mbar": "mbar|millibar",
    "psi": "psi|psig|psia|lbf/in²|lbf/in2|lb/in²|lb/in2|lbs/in²",
    "kgf/cm²": "kgf/cm²|kgf/cm2|kg/cm²|kg/cm2|kp/cm²",
    "N·m": "N·m|Nm|N m|N.m|N-m|newton metres",
    "kN·m": "kN·m|kNm|kN m",
    "kgf·m": "kgf·m|kgm|kgf.m|kgf m|kgfm|kg·m|kg-m|kpm|mkg|mkp",
    "lbf·ft": "lbf·ft|lb-ft|lb.ft|lb·ft|lbft|lbf.ft|lbf-ft|ft-lb|ft-lbs|ft.lb|ft·lb|ft lb|ft lbs|ft lbf|ft-lbf|foot-pounds|foot-pound|foot pounds|footpounds|pound-feet|lb ft|lbs-ft",
    "lbf·in": "lbf·in|lb-in|lb.in|lb·in|in-lb|in-lbs|inch-pounds|inch pounds|lbf-in|in lbs|lb in",
    "mm": "mm|millimetres|millimeters",
    "cm": "cm|centimetres|centimeters",
    "m": "m|metres|meters|metre|meter|mtr",
    "in": "in.|inch|inches|\"|″|”|''",
    "ft": "ft|ft.|foot|feet|′",
    "L/min": "L/min|l/min|lpm|LPM|litres/min|L/m",
    "L/s": "L/s|l/s|lps|litres/s",
    "L/h": "L/h|l/h|lph",
    "m³/h": "m³/h|m3/h|cbm/hr|cbm/h|m³/hr|m3/hr|cu m/h|m³/hour|m3h",
    "gpm": "gpm|GPM|US gpm|gal/min|USGPM|US gal/min|gallons/min|gals/min|gallons per minute",
    "kW": "kW",
    "W": "W|watt|watts",
    "MW": "MW",
    "hp": "hp|HP|bhp|BHP|shp|horsepower|h.p.",
    "PS": "PS",
    "L": "L|l|litres|liters|litre|liter|ltr|ltrs",
    "m³": "m³|m3|cu m|cbm|cubic metres|cu. m",
    "gal": "gal|gals|gallon|gallons|US gal|US gals|US gallons|gal.|USG",
    "gal (imp)": "imp gal|imperial gallons|imp. gal|UK gal",
    "qt": "qt|qts|quart|quarts|US qt|qt.",
    "kg": "kg|kgs|kilograms|kilos",
    "t": "t|tonne|tonnes|metric tons|metric ton|metric tonnes|mt|ton|tons",
    "short ton": "short tons|short ton",
    "long ton": "long tons|long ton",
    "lb": "lb|lbs|pound|pounds|lb.|lbs.",
}
# What else a symbol can mean.
ALSO = {"gal": ("gal (imp)",), "qt": ("qt (imp)",), "gpm": ("gpm (imp)",), "hp": ("PS",)}
TON = {"ton": ("t", "short ton", "long ton"), "tons": ("t", "short ton", "long ton")}
# Words of spec keys and notes by quantity, and key parts that are units.
KEY_QUANTITY = {
    "temperature": ("temp", "temperature"),
    "pressure": ("pressure",),
    "torque": ("torque",),
    "length": ("bore", "pitch", "stroke", "dia", "diameter", "length", "width", "height", "clearance"),
    "volume": ("sump", "volume", "content", "charge"),
    "mass": ("weight", "swl", "mass"),
    "flow": ("flow", "delivery"),
    "power": ("power", "output"),
}
KEY_UNIT = {"degf": "°F", "degc": "°C", "k": "K", "psi": "psi", "bar": "bar", "kpa": "kPa", "mpa": "MPa", "mbar": "mbar", "nm": "N·m", "lbft": "lbf·ft", "ftlb": "lbf·ft", "kgm": "kgf·m", "mm": "mm", "cm": "cm", "m": "m", "inch": "in", "inches": "in", "ft": "ft", "gpm": "gpm", "lpm": "L/min", "m3h": "m³/h", "lps": "L/s", "hp": "hp", "ps": "PS", "kw": "kW", "w": "W", "mw": "MW", "gal": "gal", "qt": "qt", "l": "L", "m3": "m³", "kg": "kg", "lb": "lb", "lbs": "lb", "t": "t"}

_EXACT: dict[str, str] = {}
_FOLDED: dict[str, str] = {}
for _unit, _forms in SPELLINGS.items():
    for _f in _forms.split("|"):
        _EXACT[_f] = _unit
        if len(_f) > 1 and _f.upper() not in ("MW", "MPA", "PS"):
            _FOLDED.setdefault(_f.lower(), _unit)


def _skeleton(word: str) -> str:
    """A word with look-alike letters made one, so that a misread unit word meets the right one."""
    w = word.replace("U", "ll").lower()
    for a, b in (("rn", "m"), ("ri", "n"), ("cl", "d"), ("vv", "w"), ("0", "o"), ("1", "l"), ("5", "s"), ("9", "g"), ("@", "a"), ("8", "b"), ("c", "e"), ("f", "t"), ("i", "l"), ("h", "b")):
        w = w.replace(a, b)
    return w


_MISREAD = {_skeleton(f): u for u, forms in SPELLINGS.items() for f in forms.split("|") if len(f) >= 4 and f.isalpha()}
_MISREAD |= {_skeleton(f.replace("-", "")): u for f, u in (("foot-pounds", "lbf·ft"), ("inch-pounds", "lbf·in"))}


def _broken_symbols() -> tuple[re.Pattern, dict[str, str]]:
    """Sequences that the symbols of numbers and units become when UTF-8 is read through a single-byte page, once or
    twice. Made by rule: encode, then decode."""
    out: dict[str, str] = {}
    for c in "°·²³½¼¾”“’″–—\xa0\xad‐¬":
        for page in ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251"):
            once = "".join(bytes([b]).decode(page, "ignore") or chr(b) for b in c.encode())
            out.setdefault(once, c)
            try:
                twice = "".join(bytes([b]).decode(page, "ignore") or chr(b) for b in once.encode())
                out.setdefault(twice, c)
            except UnicodeError:
                pass
    return re.compile("|".join(re.escape(k) for k in sorted(out, key=len, reverse=True))), out


_BROKEN, _WHOLE = _broken_symbols()
# cp1252 bytes read as cp437, where they stand beside a number or unit; and what U+FFFD stood for there.
_SINGLE = [
    (re.compile(r"(?<=\d)( ?)[░�](?=\s?[CF]\b)"), r"\1°"),
    (re.compile(r"(?<=\w)[╖�](?=(?:m|ft|in)\b)"), "·"),
    (re.compile(r"(?<=/in|/cm)[▓�]"), "²"),
    (re.compile(r"(?<=\bm)[│�](?=/h)"), "³"),
    (re.compile(r"(?<=\d m)[│�](?=[\s).,]|$)"), "³"),
    (re.compile(r"(?<=\d)╜"), "½"),
    (re.compile(r"(?<=\d)╝"), "¼"),
    (re.compile(r"(?<=\d)╛"), "¾"),
    (re.compile(r"(?<=\d)[á�](?=\d{3}(?!\d))"), "\xa0"),
    (re.compile(r"(?<=\d) [û�] (?=\d)"), " – "),
]
_FRACTION = {"½": 0.5, "¼": 0.25, "¾": 0.75, "⅛": 0.125, "⅜": 0.375, "⅝": 0.625, "⅞": 0.875}
_NUMBER = re.compile(r"\d+(?:[,\xa0]\d{3}(?!\d))*(?:[.,]\d+)?(?:\s?[½¼¾⅛⅜⅝⅞]|\s\d{1,2}/\d{1,2}(?![\d/]))?")
_UNIT_TEXT = r"°\s*[CFK]\b|deg(?:rees|ree|\.)?\s+(?:Celsius|Fahrenheit|[CF]\b)|(?:US|imp\.?|UK)\s+(?:gal\w*(?:/min)?|gpm|qt)|(?:metric|short|long)\s+ton\w*|(?:foot|inch)[- ]pounds?|cu\.?\s?m\b(?:/h)?|k?N\s?[·.]?\s?m\b|[A-Za-z@0-9]*[A-Za-z@][A-Za-z@0-9]*(?:[./·-][A-Za-z]+)*[²³23]?(?:/[A-Za-z]+[²2]?)?|\"|″|”"
_UNIT_AFTER = re.compile(r"[\s\xa0]{0,2}(" + _UNIT_TEXT + r")(\.?)(?![\w°²³/])")
_JOIN = re.compile(r"(?<=[a-z])(?:[-‐\xad¬])[ \t]*\n(?=[a-z])")
_SPEED = re.compile(r"(?<![\w.,/-])(" + _NUMBER.pattern + r")[\s\xa0]{0,2}(?:rpm|r\.p\.m\.|r/min|rev/min|revs?\.? per minute|min⁻¹)(?!\w)", re.I)
_SPEED_HINT = re.compile(r"rpm|r\.p\.m|r/min|rev|min⁻¹", re.I)
_RANGE = re.compile(r"^[\s\xa0]*(?:-|–|—|to|up to|and|bis|hasta|til|a|y|und|og)[\s\xa0]*(?:up to[\s\xa0]+)?[\s\xa0]*$")
_LONGEST = max(len(f) for forms in SPELLINGS.values() for f in forms.split("|"))
_HEAD = re.compile(rf"^[^\n|]*?(?:[\[(](?:[\w ]+:\s*)?(?P<a>[^\[\]()\n]{{1,{_LONGEST}}})[\])]|\b(?:are|is)\s+(?:given\s+|stated\s+)?in\s+(?P<b>[^\n]{{1,{_LONGEST}}}?))\.?[ \t]*$", re.M)
# what a heading must have, looked for first because it is quick
_HEAD_HINT, _HEAD_WORDS, _DIGIT = re.compile(r"[\])]\.?[ \t]*$", re.M), ("are in ", "is in ", "given in ", "stated in "), re.compile(r"\d")
_ENTRY = re.compile(r"^\s*[^\d\n|:]{2,48}?(?:\s*:\s*|[ .…]{2,}|\s)([-−]?\d[\d.,\xa0½¼¾/ ]*)[ \t]*$")
_NOTE = re.compile(r"\b(?:all\s+)?(temperature|pressure|torque|length|flow|power|volume|weight|mass)s?(?:\s+values)?(?:\s*:\s*|\s+(?:are\s+given\s+|are\s+|given\s+)?in\s+)([^\s,;]+(?:\s(?:gal|gpm|tons|m)\b)?)", re.I)


@functools.lru_cache(maxsize=65_536)
def unit_of(text: str) -> str | None:
    """The unit a piece of text names, or None."""
    t = " ".join(text.split())
    if not t:
        return None
    t = re.sub(r"°\s+", "°", t)
    got = _EXACT.get(t) or _FOLDED.get(t.lower()) if len(t) > 1 else _EXACT.get(t)
    if got is None and t.endswith("."):
        got = _EXACT.get(t[:-1]) or (_FOLDED.get(t[:-1].lower()) if len(t) > 2 else None)
        if got == "in" and t[:-1].lower() == "in":
            got = "in"
    if got is None and len(t) >= 4:
        got = _MISREAD.get(_skeleton(t.replace("-", "")))
    return got


def number_of(text: str, comma_decimal: bool = False) -> float | None:
    t = text.strip().replace("−", "-")
    sign = -1.0 if t.startswith("-") else 1.0
    t = t.lstrip("-").strip()
    extra = 0.0
    if t and t[-1] in _FRACTION:
        extra, t = _FRACTION[t[-1]], t[:-1].strip()
    elif m := re.search(r"(?:^|\s)(\d{1,2})/(\d{1,2})$", t):
        if int(m[2]):
            extra, t = int(m[1]) / int(m[2]), t[: m.start()].strip()
    t = t.replace("\xa0", "").replace(" ", "").rstrip(".,")
    if re.fullmatch(r"\d{1,3}(?:,\d{3})+(?:\.\d+)?", t) and not comma_decimal:
        t = t.replace(",", "")
    else:
        t = t.replace(",", ".")
    if t.count(".") > 1:
        t = t.replace(".", "", t.count(".") - 1) if not re.fullmatch(r"\d{1,3}(?:\.\d{3})+", t) else t.replace(".", "")
    try:
        value = (float(t) if t else 0.0) + extra
    except ValueError:
        return None
    return sign * value if value < 9e15 else None  # beyond that a double holds no whole number


def clean_text(text: str) -> str:
    if not text.isascii():
        text = _BROKEN.sub(lambda m: _WHOLE[m.group()], text)
        for pattern, whole in _SINGLE:
            text = pattern.sub(whole, text)
    return _JOIN.sub("", text)


def text_statements(text: str | None) -> list[tuple[str, float, int, str]]:
    """(unit as written, value, group, where) of a text; statements of one group say the same thing."""
    if not text or not _DIGIT.search(text):
        return []
    t = clean_text(text)
    out: list[tuple[str, float, int, str]] = []
    before: tuple[int, str, float, bool, int] | None = None  # end, number, sign, had a unit, group
    group = 0
    for m in _NUMBER.finditer(t):
        a, e = m.span()
        lead = t[a - 1] if a else " "
        sign = 1.0
        if lead.isalnum() or lead in "/_":
            before = None
            continue
        if lead in "-−":
            ahead = t[a - 2] if a > 1 else " "
            if ahead.isalpha():
                before = None
                continue
            if not (ahead.isdigit() or ahead in "½¼¾"):
                sign = -1.0
        u = _UNIT_AFTER.match(t, e)
        unit = None
        if u:
            word = u.group(1)
            if word not in ("in", "a", "A", "y", "to"):
                unit = unit_of(word)
            if unit is None and u.group(2):
                unit = unit_of(word + ".")
            if unit is not None and t[u.end() : u.end() + 1] == "-" and t[u.end() + 1 : u.end() + 2].isalnum():
                unit = None
            if unit == "t" and word in ("ton", "tons"):
                unit = word
        if unit is None:
            before = (e, m.group(), sign, False, group)
            continue
        value = number_of(m.group())
        if value is None:
            before = None
            continue
        gap = t[before[0] : a - (sign < 0)] if before else ""
        same = before is not None and before[3] and re.fullmatch(r"[^\d\n]{0,16}[(=][\s\xa0]*", gap) is not None
        if not same:
            group += 1
        out.append((unit, value * sign, group, "number"))
        if before and not before[3] and _RANGE.match(gap):
            low = number_of(before[1])
            if low is not None:
                out.append((unit, low * before[2], -group, "number"))
        before = (u.end(), m.group(), sign, True, group)
    # units that stand once for several numbers
    for h in _HEAD.finditer(t) if _HEAD_HINT.search(t) or any(w in t for w in _HEAD_WORDS) else ():
        unit = unit_of(h.group("a") or h.group("b") or "")
        if unit is None:
            continue
        for line in t[h.end() + 1 :].split("\n"):
            if not (x := _ENTRY.match(line)):
                if line.strip() and not re.search(r"\d[\d.,]*\s*\S+\s*$", line) or not line.strip():
                    break
                continue
            value = number_of(x.group(1))
            if value is not None:
                group += 1
                out.append((unit, value, group, "heading"))
    if "|" in t:
        out += _table_statements(t, group)
    return out


def text_speeds(text: str | None) -> list[tuple[str, float, int, str]]:
    """Distinct speeds of rotation that a text states."""
    if not text or not _SPEED_HINT.search(text):
        return []
    found = {number_of(m.group(1)): None for m in _SPEED.finditer(clean_text(text))}
    return [("rpm", v, 0, "number") for v in found if v]


def _table_statements(t: str, group: int) -> list[tuple[str, float, int, str]]:
    """Columns of a table whose head names a unit."""
    out: list[tuple[str, float, int, str]] = []
    units: dict[int, str] = {}
    for line in t.split("\n"):
        s = line.strip()
        if not (s.startswith("|") and s.endswith("|")):
            units = {}
            continue
        cells = [c.strip() for c in s.strip("|").split("|")]
        if all(re.fullmatch(r"[\s:\-]*", c) for c in cells):
            continue
        named = {i: u for i, c in enumerate(cells) if (m := re.search(r"[\[(]([^\[\]()]+)[\])]\s*$|,\s*([^,]+)$", c)) and not c[:1].isdigit() and (u := unit_of(m.group(1) or m.group(2)))}
        if named:
            units = named
            continue
        for i, u in units.items():
            if i < len(cells) and re.fullmatch(r"[-−]?\d[\d.,\xa0½¼¾/ ]*", cells[i]):
                value = number_of(cells[i])
                if value is not None:
                    group += 1
                    out.append((u, value, group, "heading"))
    return out


def key_of(key: str) -> tuple[str | None, str | None]:
    """(quantity, unit) that a spec key names."""
    parts = [p for p in re.split(r"[^a-z0-9³²]+", key.lower()) if p and p != "in"]
    unit = next((KEY_UNIT[p] for p in (*parts[::-1],) if p in KEY_UNIT), None)
    if unit:
        return UNITS[unit][0], unit
    words = set(parts)
    if "capacity" in words:
        return ("volume" if words & {"oil", "tank", "fuel", "water"} else "flow"), None
    for quantity, names in KEY_QUANTITY.items():
        if words & set(names):
            return quantity, None
    return None, None


def spec_statements(specs: dict | list | None, notes: str | None) -> list[tuple[str, float, int, str]]:
    """Statements of a map of specs with its notes; a value with no unit anywhere has unit '?quantity'."""
    noted = {}
    for m in _NOTE.finditer(notes or ""):
        word = m.group(2).rstrip(".,;") if unit_of(m.group(2)) is None else m.group(2)
        if unit := unit_of(word):
            noted[UNITS[unit][0]] = unit
    out: list[tuple[str, float, int, str]] = []
    group = 0
    for key, value in specs.items() if isinstance(specs, dict) else specs or ():
        if value is None or key is None:
            continue
        group += 1000
        quantity, unit = key_of(key)
        stated = text_statements(value)
        if stated:
            out += [(u, v, g + group if g > 0 else g - group, w) for u, v, g, w in stated]
            continue
        m = re.search(r"(?<![\w.])[-−]?" + _NUMBER.pattern, clean_text(value))
        number = number_of(m.group()) if m and not re.search(r"[A-Za-z]{2,}\d|\d[A-Za-z]", value) else None
        if number is None:
            continue
        if key.lower() == "rpm":
            out.append(("rpm", number, group, "key"))
        elif unit:
            out.append((unit, number, group, "key"))
        elif quantity and quantity in noted:
            out.append((noted[quantity], number, group, "note"))
        elif quantity:
            out.append((f"?{quantity}", number, group, "none"))
    out += [(u, v, g + 10**6 if g > 0 else g - 10**6, w) for u, v, g, w in text_statements(notes)]
    return out


def candidates(unit: str) -> tuple[str, ...]:
    if unit.startswith("?"):
        return tuple(u for u, (q, _, _) in UNITS.items() if q == unit[1:] and "(imp)" not in u)
    if unit in TON:
        return TON[unit]
    return (unit, *ALSO.get(unit, ()))


def to_common(unit: str, value: float) -> float:
    _, factor, offset = UNITS[unit]
    return (value + offset) * factor


def _components(ties: list[list[int]]) -> list[set[int]]:
    """Sets of open statements that ties connect."""
    out: list[set[int]] = []
    for members in ties:
        if members:
            joined = set(members).union(*[c for c in out if not c.isdisjoint(members)])
            out = [c for c in out if c.isdisjoint(members)] + [joined]
    return out


def _least(factors: list[tuple[tuple[int, ...], dict]], fixed: dict[int, int]) -> tuple[int, float, int]:
    """The least sum of the factors over all picks that agree with ``fixed``, by eliminating one statement after another:
    the work grows with how many statements meet in one tie, not with how many there are."""
    live = []
    for own, worth in factors:
        free = tuple(j for j, i in enumerate(own) if i not in fixed)
        live.append((tuple(own[j] for j in free), {tuple(p[j] for j in free): w for p, w in worth.items() if all(fixed.get(i, k) == k for i, k in zip(own, p))}))
    while names := {i for own, _ in live for i in own}:
        out = min(sorted(names), key=lambda i: len({j for own, _ in live if i in own for j in own}))
        met = [f for f in live if out in f[0]]
        rest = tuple(sorted({j for own, _ in met for j in own} - {out}))
        sizes = {i: {p[own.index(i)] for own, worth in met if i in own for p in worth} for i in (*rest, out)}
        table = {}
        for pick in product(*[sorted(sizes[i]) for i in rest]):
            at = dict(zip(rest, pick))
            table[pick] = min(tuple(map(sum, zip(*[worth[tuple({**at, out: k}[i] for i in own)] for own, worth in met]))) for k in sorted(sizes[out]))
        live = [f for f in live if out not in f[0]] + [(rest, table)]
    return tuple(map(sum, zip(*[worth[()] for _, worth in live])))


def resolve(statements: list[tuple[str, float, int, str]], tolerance: float = 0.06) -> list[tuple[str, str, float, str, bool, bool]]:
    """(quantity, unit, value in the common unit, where, unique, common) of each statement.

    Combinations are searched only among statements that an identity ties together and whose unit is open; statements
    that share no identity are solved apart, each set exactly and however large."""
    rpm = [v for u, v, _, _ in statements if u == "rpm"]
    said = [s for s in statements if s[0] != "rpm"]
    options = [candidates(u) for u, *_ in said]
    chosen = [o[0] for o in options]
    unique = [len(o) == 1 for o in options]
    groups: dict[int, list[int]] = {}
    for i, (_, _, g, _) in enumerate(said):
        if g > 0:
            groups.setdefault(g, []).append(i)
    by_quantity: dict[str, list[int]] = {}
    for i, o in enumerate(options):
        by_quantity.setdefault(UNITS[o[0]][0], []).append(i)

    ties: list[tuple[list[int], object]] = []
    for g in groups.values():
        for a, b in zip(g, g[1:]):
            ties.append(([a, b], lambda x, y: abs(math.log(x / y)) if x > 0 and y > 0 else (0.0 if abs(x - y) <= 1.0 else 9.0)))
    # a quantity stated once, be it in two units or as a range, meets the others with either end
    single: dict[str, list[int]] = {}
    for q, members in by_quantity.items():
        once: dict[object, list[int]] = {}
        for i in members:
            once.setdefault(abs(said[i][2]) or (i,), []).append(i)
        if len(once) == 1:
            high, low = ([i for i in members if (said[i][2] < 0) == below] for below in (False, True))
            single[q] = high[:1] + low[:1]

    def tie(quantities: tuple[str, ...], residual) -> None:
        if single.keys() >= set(quantities):
            ties.extend((list(pick), residual) for pick in product(*[single[q] for q in quantities]))

    for w in (2 * math.pi * v / 60 / 1000 for v in rpm[:1] if len(rpm) == 1 and v > 0):
        tie(("power", "torque"), lambda p, t, w=w: abs(math.log(p / (t * w))) if p > 0 and t > 0 else 9.0)
    tie(("power", "pressure", "flow"), lambda p, k, q: abs(math.log(p / (k * q / 60_000))) if min(p, k, q) > 0 else 9.0)
    for density in (0.85, 1.0):
        tie(("mass", "volume"), lambda m, v, d=density: abs(math.log(m / (v * d))) if m > 0 and v > 0 else 9.0)
    for part in _components([[i for i in members if len(options[i]) > 1] for members, _ in ties]):
        within = [t for t in ties if not part.isdisjoint(t[0])]
        factors = []
        for members, residual in within:
            own = tuple(i for i in members if i in part)
            worth = {}
            for pick in product(*[range(len(options[i])) for i in own]):
                at = dict(zip(own, pick))
                r = residual(*[to_common(options[i][at[i]] if i in at else chosen[i], said[i][1]) for i in members])
                worth[pick] = (-1, r, 0) if r <= tolerance else (0, 0.0, 0)
            factors.append((own, worth))
        factors += [((i,), {(k,): (0, 0.0, k) for k in range(len(options[i]))}) for i in sorted(part)]
        marginal = {i: [_least(factors, {i: k}) for k in range(len(options[i]))] for i in part}
        best = min(m for x in marginal.values() for m in x)
        if best[0] == 0:
            continue
        fixed: dict[int, int] = {}
        for i in sorted(part):
            fixed[i] = min(range(len(options[i])), key=lambda k: (_least(factors, {**fixed, i: k}), k))
            unique[i] = sum(m[0] == best[0] and m[1] <= best[1] + 0.01 for m in marginal[i]) == 1
        for i, k in fixed.items():
            chosen[i] = options[i][k]
    out = []
    for (u, v, _, where), unit, sure in zip(said, chosen, unique):
        if u.startswith("?") and not sure:
            continue
        quantity = UNITS[unit][0]
        out.append((quantity, unit, to_common(unit, v), "inferred" if u.startswith("?") else where, sure, unit == COMMON[quantity]))
    return out


STATEMENT = T.ArrayType(
    T.StructType(
        [
            T.StructField("quantity", T.StringType()),
            T.StructField("unit", T.StringType()),
            T.StructField("value", T.DoubleType()),
            T.StructField("unit_from", T.StringType()),
            T.StructField("unique", T.BooleanType()),
            T.StructField("is_common", T.BooleanType()),
        ]
    )
)


def _structs(rows: list[tuple]) -> list[dict]:
    return [dict(zip(STATEMENT.elementType.fieldNames(), r)) for r in rows]


@F.pandas_udf(STATEMENT)
def _from_text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        yield pd.Series([_structs(resolve(text_statements(t) + text_speeds(t))) for t in texts])


@F.pandas_udf(STATEMENT)
def _from_specs(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for specs, notes in parts:
        yield pd.Series([_structs(resolve(spec_statements(s, n))) for s, n in zip(specs, notes)])


def text_quantities(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(record_id, quantity, unit, value, unit_from, unique, is_common), one row per statement of the text."""
    return df.where(F.col(text).rlike(r"\d")).select(F.col(key).cast("string").alias("record_id"), F.explode(_from_text(F.col(text))).alias("s")).select("record_id", "s.*")


def spec_quantities(df: DataFrame, key: str, specs: str = "specs", notes: str = "notes") -> DataFrame:
    return df.select(F.col(key).cast("string").alias("record_id"), F.explode(_from_specs(F.col(specs), F.col(notes))).alias("s")).select("record_id", "s.*")


def nearest(value: Column) -> Column:
    """Nearest whole number; exact halves to even, after removing the noise of binary fractions."""
    return F.bround(F.round(value, 9), 0).cast("bigint")


def converted(statements: DataFrame, targets: DataFrame) -> DataFrame:
    """(record_id, quantity, common_value): each distinct value stated in another unit than the common one. targets is
    the table of common units; a quantity that is not in it is left out."""
    wanted = F.broadcast(targets.where(F.col("quantity").isin(*COMMON)).select("quantity").distinct())  # at most one row per known quantity
    odd = statements.where("not is_common and unit_from <> 'inferred'").join(wanted, "quantity")
    return odd.select("record_id", "quantity", nearest(F.col("value")).alias("common_value")).distinct()
