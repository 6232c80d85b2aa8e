"""Column functions over route events, log messages and alerts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Redaction patterns in the order they apply; later ones see earlier replacements.
PII = (
    ("[SSN]", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("[IBAN]", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{4}[0-9]{7}([A-Z0-9]?){0,16}\b"),
    ("[CREDIT_CARD]", r"\b(?:4[0-9]{3}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}|5[1-5][0-9]{2}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}|3[47][0-9]{2}[- ]?[0-9]{6}[- ]?[0-9]{5}|3(?:0[0-5]|[68][0-9])[0-9][- ]?[0-9]{6}[- ]?[0-9]{4}|6(?:011|5[0-9]{2})[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4})\b"),
    ("[IPv6]", r"([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}"),
    ("[IPv4]", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"),
    ("[EMAIL]", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"),
    ("[PHONE]", r"\b(\+?[1-9]\d{0,2}[\s.\-]?)?\(?\d{3}\)?[\s.\-]?\d{3}[\s.\-]?\d{4}\b"),
)
#: What a text must contain for a pattern to be tried at all.
PII_GUARD = {"[SSN]": "-", "[IPv6]": ":", "[EMAIL]": "@"}
#: What must match in a text for the other patterns to be tried.
PII_SHAPE = {"[IPv4]": r"[0-9]\.[0-9]", "[IBAN]": "[A-Z]{2}[0-9]{2}", "[CREDIT_CARD]": "[0-9]{4}", "[PHONE]": "[0-9]{4}"}
#: What every match of any pattern holds: a text without it is left alone after one look.
PII_ANY = "[0-9@:]"
#: Names of well-known networks.
AS_NAMES = {15169: "Google", 8075: "Microsoft", 16509: "Amazon AWS", 13335: "Cloudflare", 32934: "Meta", 714: "Apple", 2906: "Netflix", 20940: "Akamai", 6939: "Hurricane Electric", 1299: "Telia", 3356: "Lumen", 174: "Cogent", 3320: "Deutsche Telekom", 2914: "NTT", 7018: "AT&T", 4134: "China Telecom", 7922: "Comcast"}
#: Collectors as (id, city, country, latitude, longitude, exchange, region).
COLLECTORS = (
    ("rrc00", "Amsterdam", "NL", 52.3702, 4.8952, "AMS-IX", "EU"),
    ("rrc01", "Dresden", "DE", 51.0504, 13.7373, "DE-CIX Dresden", "EU"),
    ("rrc02", "Frankfurt", "DE", 50.1109, 8.6821, "DE-CIX Frankfurt", "EU"),
    ("rrc03", "New York", "US", 40.7128, -74.0060, "NYIIX", "NA"),
    ("rrc04", "Dublin", "IE", 53.3498, -6.2603, "Dublin Internet Exchange", "EU"),
    ("rrc05", "San Jose", "US", 37.3382, -121.8863, "Equinix", "NA"),
    ("rrc06", "Ljubljana", "SI", 46.0569, 14.5058, "LIX", "EU"),
    ("rrc07", "Bonn", "DE", 50.7374, 7.0982, "Cologne IX", "EU"),
    ("rrc08", "Warsaw", "PL", 52.2297, 21.0122, "PLIX Warsaw", "EU"),
    ("rrc09", "Zurich", "CH", 47.3769, 8.5417, "SWISSIX", "EU"),
    ("rrc10", "Stockholm", "SE", 59.3293, 18.0686, "STHIX", "EU"),
    ("rrc11", "Montreal", "CA", 45.5017, -73.5673, "Montreal Peer", "NA"),
    ("rrc12", "Frankfurt", "DE", 50.1109, 8.6821, "DE-CIX Frankfurt", "EU"),
    ("rrc13", "Kigali", "RW", -1.9736, 30.1044, "RINAX", "AF"),
    ("rrc14", "Chisinau", "MD", 47.0105, 28.8638, "MOLNAP", "EU"),
    ("rrc15", "Poznan", "PL", 52.4064, 16.9252, "PLIX Poznan", "EU"),
    ("rrc16", "London", "GB", 51.5074, -0.1278, "LINX London", "EU"),
    ("rrc17", "Singapore", "SG", 1.3521, 103.8198, "Equinix SG", "APAC"),
    ("rrc18", "Porto", "PT", 41.1579, -8.6291, "PTIX", "EU"),
    ("rrc19", "Helsinki", "FI", 60.1699, 24.9384, "HEIX", "EU"),
    ("rrc20", "Istanbul", "TR", 41.0082, 28.9784, "ILS", "EU"),
    ("rrc21", "Brisbane", "AU", -27.4698, 153.0251, "APNIC", "OC"),
    ("rrc22", "Manila", "PH", 14.5995, 120.9842, "PhXL", "APAC"),
    ("rrc23", "Casablanca", "MA", 33.5731, -7.5898, "MA-IX", "AF"),
    ("rrc24", "Bogota", "CO", 4.7110, -74.0721, "Compulink", "SA"),
    ("rrc25", "Quito", "EC", -0.1807, -78.4678, "NIC Ecuador", "SA"),
)
EARTH_KM, FIBRE_KM_PER_S = 6371.0, 200_000.0
U64 = 18446744073709551616


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _guard(text: Column, token: str) -> Column:
    return text.contains(PII_GUARD[token]) if token in PII_GUARD else text.rlike(PII_SHAPE[token])


def _pii_step(state: Column, token: str, pattern: str) -> Column:
    """One replacement. Binding the state to a lambda variable keeps the expression linear in the number of steps."""

    def step(s: Column) -> Column:
        text, guard = s["text"], _guard(s["text"], token)
        n = F.when(guard, F.regexp_count(text, F.lit(pattern))).otherwise(0)
        # without a match there is nothing to replace
        return let(n, lambda k: F.struct(F.when(k > 0, F.regexp_replace(text, pattern, token)).otherwise(text).alias("text"), F.concat(s["counts"], F.array(k)).alias("counts")))

    return let(state, step)


def pii_scan(text: Column) -> Column:
    """struct(text, counts): the redacted text and the matches of every step on the text as redacted so far."""
    state = F.struct(text.alias("text"), F.array().cast("array<int>").alias("counts"))
    for token, pattern in PII:
        state = _pii_step(state, token, pattern)
    none = F.struct(text.alias("text"), F.array(*[F.lit(0)] * len(PII)).alias("counts"))
    return F.when(text.rlike(PII_ANY), state).otherwise(none)


def pii_redact(text: Column) -> Column:
    """Seven ordered replacements, each behind a cheap guard, and all behind one that most texts don't pass; nothing is counted."""

    def without(token: str, pattern: str) -> Callable[[Column], Column]:
        return lambda t: F.when(_guard(t, token), F.regexp_replace(t, pattern, token)).otherwise(t)

    redacted = text
    for token, pattern in PII:
        redacted = let(redacted, without(token, pattern))
    return F.when(text.rlike(PII_ANY), redacted).otherwise(text)


def pii_hits(text: Column) -> tuple[Column, Column]:
    """Total matches, and the names of the kinds that matched in order. A null text has none."""
    counts = pii_scan(text)["counts"]
    total = F.aggregate(counts, F.lit(0), lambda s, n: s + F.coalesce(n, F.lit(0)))
    names = F.array(*[F.lit(token.strip("[]")) for token, _ in PII])
    kinds = F.zip_with(counts, names, lambda n, name: F.when(n > 0, name))
    return total, F.array_compact(kinds)


def pii_redacted(text: Column) -> Column:
    """struct(text, hits): the redacted text and its total of matches, in one scan."""
    return let(pii_scan(text), lambda s: F.struct(s["text"].alias("text"), F.aggregate(s["counts"], F.lit(0), lambda n, c: n + F.coalesce(c, F.lit(0))).alias("hits")))


def message_key(text: Column) -> Column:
    return F.sha2(F.lower(F.trim(text)), 256)


def path_hash(path: Column) -> Column:
    """h * 31 + asn modulo 2**64 over the path, as decimal(20,0); 0 for an empty path."""
    return F.aggregate(path, F.lit(0).cast("decimal(20,0)"), lambda h, a: ((h * 31 + a) % F.lit(str(U64)).cast("decimal(20,0)")).cast("decimal(20,0)"))


def parse_asn(text: Column) -> Column:
    """The number of an AS, with or without its prefix; null unless it fits 32 bits."""
    n = F.regexp_extract(F.trim(text), "^(?i:AS)?([0-9]{1,10})$", 1).try_cast("long")
    return F.when(n.between(0, 4294967295), n)


def prefix_length(prefix: Column) -> Column:
    n = F.get(F.split(prefix, "/"), F.lit(1)).try_cast("int")
    return F.when(n.between(0, 255), n)


def unusual_prefix_length(prefix: Column) -> Column:
    n = prefix_length(prefix)
    return F.coalesce(F.when(prefix.contains(":"), ~n.between(32, 48)).otherwise(~n.between(8, 24)), F.lit(False))


OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def v4_bits(address: Column) -> Column:
    parts = F.transform(F.split(address, r"\."), lambda o: F.lpad(F.bin(o.cast("long")), 8, "0"))
    return F.when(address.rlike(rf"^{OCTET}(\.{OCTET}){{3}}$"), F.array_join(parts, ""))


def dotted_tail(address: Column) -> Column:
    """An IPv6 address whose last 32 bits are written as an IPv4 address, in hex groups; any other text as it is."""
    parts = F.split(F.regexp_extract(address, rf"({OCTET}(\.{OCTET}){{3}})$", 1), r"\.")
    two = lambda i: F.lower(F.hex(parts[i].cast("long") * 256 + parts[i + 1].cast("long")))
    tailed = address.rlike(rf":{OCTET}(\.{OCTET}){{3}}$")
    return F.when(tailed, F.concat(F.regexp_extract(address, r"^(.*:)[0-9.]*$", 1), two(0), F.lit(":"), two(2))).otherwise(address)


def v6_bits(text: Column) -> Column:
    """128 bits of an IPv6 address in hex groups, with or without one ``::`` and with or without a dotted end."""
    return let(dotted_tail(text), _v6_bits)


def _v6_bits(address: Column) -> Column:
    group = "[0-9a-fA-F]{1,4}"
    groups = lambda t: F.filter(F.split(t, ":"), lambda g: g != "")
    shaped = (address != "") & address.rlike(f"^({group}(:{group})*)?(::({group}(:{group})*)?)?$")
    halves = F.split(address, "::", -1)
    sides = let(halves, lambda h: F.struct(groups(h[0]).alias("l"), groups(F.coalesce(F.get(h, F.lit(1)), F.lit(""))).alias("r"), (F.size(h) > 1).alias("short")))

    def whole(s: Column) -> Column:
        missing = 8 - F.size(s["l"]) - F.size(s["r"])
        full = F.concat(s["l"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), s["r"])
        return F.when(F.when(s["short"], missing >= 1).otherwise(missing == 0), F.array_join(F.transform(full, lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), ""))

    return F.when(shaped, let(sides, whole))


def prefix_bits(prefix: Column) -> Column:
    """struct(family 4 or 6, plen, bits of the whole address); null for an invalid prefix."""

    def parsed(p: Column) -> Column:
        six = p["address"].contains(":")
        bits = F.when(six, v6_bits(p["address"])).otherwise(v4_bits(p["address"]))
        return F.struct(F.when(six, 6).otherwise(4).alias("family"), p["plen"].alias("plen"), bits.alias("bits"))

    def split(parts: Column) -> Column:
        n = F.get(parts, F.lit(1)).try_cast("int")
        return F.struct(parts[0].alias("address"), F.when((F.size(parts) == 2) & n.between(0, 128), n).alias("plen"))

    fits = lambda b: F.when(b["bits"].isNotNull() & (b["plen"] <= F.when(b["family"] == 6, 128).otherwise(32)), b)
    return let(let(let(F.split(prefix, "/"), split), parsed), fits)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return EARTH_KM * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def light_transit_ms(km: Column) -> Column:
    return km / FIBRE_KM_PER_S * 1000


def alert_fingerprint(kind: Column, prefix: Column, asn: Column) -> Column:
    return F.sha2(F.concat_ws(":", kind, prefix, asn.cast("string")), 256)


def escalation_level(confidence: Column) -> Column:
    return F.when(confidence < 0.5, None).when(confidence < 0.7, "warning").when(confidence < 0.9, "critical").otherwise("emergency")


def wave_classification(score: Column) -> Column:
    return F.when(score < 0.3, "Normal").when(score < 0.6, "Suspicious").otherwise("Anomalous")


def z_score(v: Column, mean: Column, std: Column) -> Column:
    return F.when(std == 0, 0.0).otherwise((v - mean) / std)


def ema_z_score(v: Column, ema: Column, var: Column, n: Column) -> Column:
    """Null below five samples."""
    return F.when(n >= 5, (v - ema) / F.sqrt(var + 1e-6))


def is_anomaly(z: Column, threshold: float = 3.0) -> Column:
    return F.coalesce(F.abs(z) > threshold, F.lit(False))


def gap_ratio(times_ms: Column, limit_ms: float = 4.0) -> Column:
    """Share of the gaps between consecutive arrivals that are longer than the limit; 0 for fewer than two."""
    t = F.array_sort(times_ms)
    gaps = F.zip_with(F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), lambda b, a: b - a)
    return F.when(F.size(t) < 2, 0.0).otherwise(F.size(F.filter(gaps, lambda g: g > limit_ms)) / F.greatest(F.size(gaps), F.lit(1)))


def order_deviation(actual: Column, expected: Column) -> Column:
    """1 minus the overlap of the first three collectors; 0 without expectation or with fewer than two arrivals."""
    a, e = F.slice(actual, 1, 3), F.slice(expected, 1, 3)
    return F.when((F.size(expected) == 0) | (F.size(actual) < 2), 0.0).otherwise(1 - F.size(F.array_intersect(a, e)) / F.greatest(F.least(F.size(a), F.size(e)), F.lit(1)))


def propagation_speed(spread_ms: Column, km: Column) -> Column:
    """Spread over the light time of the farthest pair, within 0 and 1; it rises with the spread. 0 without a known pair."""
    return F.when(F.coalesce(km, F.lit(0.0)) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), spread_ms / F.greatest(light_transit_ms(km), F.lit(0.001)))))


def flatten_path(path: Column) -> Column:
    """A path of JSON texts: a set gives its first item, a number or numeric text its value, anything else 0."""
    item = lambda x: F.when(x.startswith("["), F.get_json_object(x, "$[0]")).otherwise(x)
    return F.transform(path, lambda x: F.coalesce(F.trim(item(x), F.lit('"')).try_cast("long"), F.lit(0).cast("long")))


def _names() -> Column:
    return F.create_map(*[x for k, v in AS_NAMES.items() for x in (F.lit(k).cast("long"), F.lit(v))])


def as_name(asn: Column) -> Column:
    return F.coalesce(F.try_element_at(_names(), asn.cast("long")), F.concat(F.lit("AS"), asn.cast("string")))


def path_display(path: Column, peer: Column) -> Column:
    """Names or numbers of the last four hops; the peer's name for an empty path."""
    last = F.when(F.size(path) > 4, F.slice(path, -4, 4)).otherwise(path)
    shown = F.transform(last, lambda a: F.coalesce(F.try_element_at(_names(), a.cast("long")), a.cast("string")))
    return F.when(F.size(path) == 0, as_name(peer)).otherwise(F.array_join(shown, " → "))


def iso_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def next_midnight(ts: Column) -> Column:
    return F.date_add(F.to_date(ts), 1)


def next_month_start(ts: Column) -> Column:
    return F.add_months(F.trunc(ts, "month"), 1)


def json_text(value: Column) -> Column:
    """The text of a JSON string given as a variant; null for other types."""
    return F.when(F.to_json(value).startswith('"'), value.cast("string"))


def api_key_hash(key: Column) -> Column:
    return F.sha2(key, 256)


def path_length(path: Column) -> Column:
    """Hops of a path; null for a null path."""
    return F.when(path.isNotNull(), F.size(path))


def prefix_param(text: Column) -> Column:
    """A prefix as it stands in a request, with escaped slashes and colons decoded in either case of letters."""
    return F.regexp_replace(F.regexp_replace(text, "%2[Ff]", "/"), "%3[Aa]", ":")


def prefix_param_valid(text: Column) -> Column:
    """Whether a decoded prefix holds only hex digits, dots, colons and slashes."""
    return F.coalesce(text.rlike("^[0-9a-fA-F.:/]+$"), F.lit(False))
