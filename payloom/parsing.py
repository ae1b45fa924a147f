"""Parsers for the textual forms that users give: ranges, flags, times, networks, lists, numbers."""

from __future__ import annotations

import datetime as dt
import ipaddress
import re
import socket
from dataclasses import dataclass
from pathlib import Path

#: Names that the host's service and protocol tables may lack (fixed values, IANA).
SERVICES = {"ftp": 21, "ssh": 22, "telnet": 23, "smtp": 25, "domain": 53, "bootps": 67, "bootpc": 68, "finger": 79, "http": 80, "auth": 113, "ntp": 123, "imap": 143, "snmp": 161, "https": 443, "imaps": 993}
PROTOCOLS = {"icmp": 1, "igmp": 2, "ipip": 4, "tcp": 6, "udp": 17, "rsvp": 46, "gre": 47, "esp": 50, "ah": 51, "ospf": 89}


@dataclass(frozen=True)
class Span:
    """A closed range; an upper bound of 0 means none."""

    low: float
    high: float

    def holds(self, value: float) -> bool:
        return value >= self.low and (value <= self.high or self.high == 0)


def tokens(text: str, separators: str = ",; ") -> list[str]:
    """The non-empty parts between any of the separators."""
    return [t for t in re.split(f"[{re.escape(separators)}]", text) if t]


def quoted_tokens(text: str, separators: str = " \t") -> list[str]:
    """As tokens, but what stands in double quotes is one part."""
    return [a if a else b for a, b in re.findall(rf'"([^"]*)"|([^{re.escape(separators)}"]+)', text) if a or b]


def word_tokens(text: str, also: str = "") -> list[str]:
    """Runs of ASCII letters, digits and the characters in also."""
    return re.findall(rf"[A-Za-z0-9{re.escape(also)}]+", text)


def is_number(text: str) -> bool:
    """Digits only; the empty string counts."""
    return re.fullmatch("[0-9]*", text) is not None


def integer(text: str) -> int:
    """Base 16 after 0x, base 8 after 0, else base 10."""
    text = text.strip()
    sign, digits = (-1, text[1:]) if text[:1] == "-" else (1, text)
    if digits.lower().startswith("0x"):
        return sign * int(digits[2:], 16)
    return sign * int(digits, 8 if len(digits) > 1 and digits[0] == "0" else 10)


def hexadecimal(text: str) -> int:
    """The leading hexadecimal digits of text, 0 if none."""
    found = re.match("[0-9A-Fa-f]*", text).group()
    return int(found, 16) if found else 0


def to_fixed(text: str, factor: int) -> int:
    """A decimal number times factor, rounded half away from zero."""
    from decimal import ROUND_HALF_UP, Decimal

    return int((Decimal(text.strip() or "0") * factor).quantize(Decimal(1), ROUND_HALF_UP))


def from_fixed(value: int, factor: int, places: int) -> str:
    """value / factor to a number of places, truncated."""
    sign, value = ("-", -value) if value < 0 else ("", value)
    whole, rest = divmod(value, factor)
    return f"{sign}{whole}" + (f".{rest * 10**places // factor:0{places}d}" if places else "")


def _service(name: str) -> int:
    try:
        return socket.getservbyname(name)
    except OSError:
        return SERVICES[name.lower()]


def _protocol(name: str) -> int:
    try:
        return socket.getprotobyname(name)
    except OSError:
        return PROTOCOLS[name.lower()]


def _ranges(text: str, read) -> list[Span]:
    out = []
    for item in tokens(text):
        bounds = tokens(item, "-:")
        low = read(bounds[0])
        out.append(Span(low, read(bounds[1]) if len(bounds) > 1 else low))
    return out


def _named(read_name):
    return lambda text: integer(text) if text[:1].isdigit() else read_name(text)


def int_ranges(text: str) -> list[Span]:
    """`2-6,34-90`, `2:6;34`, `0x50`, `5-0` (no upper bound), `0` (everything)."""
    return _ranges(text, integer)


def double_ranges(text: str) -> list[Span]:
    return _ranges(text, float)


def port_ranges(text: str) -> list[Span]:
    """Integer ranges whose bounds may be names of services."""
    return _ranges(text, _named(_service))


def protocol_ranges(text: str) -> list[Span]:
    """Integer ranges whose bounds may be names of protocols."""
    return _ranges(text, _named(_protocol))


def yes(text: str) -> bool:
    """A leading positive number, a word with y, t, i or s in front, or on."""
    text = text.strip().lower()
    number = re.match(r"[+-]?\d+", text)
    return bool(number and int(number.group()) > 0) or text[:1] in tuple("ytis") or text == "on"


#: Forms of dates and times, tried in this order.
TIME_FORMS = ("%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d", "%Y%m%d %H:%M:%S", "%Y%m%d %H:%M", "%Y%m%d%H%M%S", "%Y%m%d", "%Y/%m/%d %H:%M:%S", "%Y/%m/%d %H:%M", "%Y/%m/%d", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y %H:%M", "%m/%d/%Y", "%m/%d/%y", "%d %b %Y %H:%M:%S", "%d %b %Y", "%d %B %Y", "%b %d %Y %H:%M:%S", "%b %d %Y", "%B %d %Y", "%B %d, %Y", "%H:%M:%S", "%H:%M")


def time(text: str) -> dt.datetime | None:
    """The time that text gives in any of the forms, today where it gives no day; None if in none."""
    for form in TIME_FORMS:
        try:
            found = dt.datetime.strptime(text.strip(), form)
        except ValueError:
            continue
        return found if "%d" in form else dt.datetime.combine(dt.date.today(), found.time())
    return None


def time_range(text: str) -> tuple[dt.datetime | None, dt.datetime | None]:
    """start,end; a part that is missing or can't be read is None, without a bound."""
    start, _, end = text.partition(",")
    return time(start), time(end)


def day_range(text: str) -> tuple[dt.date, dt.date]:
    """begin-end as yyyymmdd, the end excluded."""
    begin, end = tokens(text, "-")
    return tuple(dt.datetime.strptime(x, "%Y%m%d").date() for x in (begin, end))


def next_day(day: dt.date) -> dt.date:
    return day + dt.timedelta(days=1)


def previous_day(day: dt.date) -> dt.date:
    return day - dt.timedelta(days=1)


def window_of(modified: dt.datetime) -> tuple[dt.date, dt.date]:
    """The days that an alert file of the given modification time may speak of: a week before to a day after."""
    return (modified - dt.timedelta(days=7)).date(), (modified + dt.timedelta(days=1)).date()


def address(text: str) -> int:
    """A dotted IPv4 address, or a hexadecimal or decimal number, as an integer."""
    text = text.strip()
    if text.lower().startswith("0x"):
        return int(text, 16)
    return int(text) if text.isdigit() else int(ipaddress.IPv4Address(text))


def address6(text: str) -> int:
    """An IPv4 or IPv6 address as an integer."""
    return int(ipaddress.IPv6Address(text)) if ":" in text else address(text)


def cidr(text: str) -> tuple[int, int]:
    """(subnet, mask); without a slash the mask is whole."""
    host, _, bits = text.strip().partition("/")
    width = int(bits) if bits else 32
    if not 0 <= width <= 32:
        raise ValueError(f"bad prefix length in {text!r}")
    mask = (0xFFFFFFFF << (32 - width)) & 0xFFFFFFFF
    return address(host) & mask, mask


def cidrs(text: str) -> list[tuple[int, int]]:
    return [cidr(t) for t in tokens(text)]


def list_or_file(text: str, space: str = ";") -> str:
    """text, or with file=path what the file has, white space as space."""
    return re.sub(r"\s+", space, Path(text[5:]).read_text().strip()) if text.startswith("file=") else text
