"""Personal data by a linear-chain conditional random field (operator 6).

Tokens are runs of characters between white space (of any script), brackets, quotes, commas, semicolons,
slashes, equal signs and the like; they are cut also where wide scripts (without blanks between words)
meet ASCII, at colons (but for runs of hexadecimal digits and colons, as in IPv6 addresses), and lose full stops and marks at
their ends. A token's features are its word shape: which classes of characters it holds and how
many, how its parts are laid out (a name, an @ and a domain; four numbers between dots; groups of digits), what the gap before it holds,
and whether it is one of a few words that announce data (password, call, card, isbn). They form a bit code; the codes of its
neighbours are features too. The model is trained here, by gradient ascent on the exact
log-likelihood (forward and backward), on a small labelled table: texts with the spans that are personal. `labelled_table` writes the default one out (plain
words in several scripts, e-mail addresses, telephone numbers, IP addresses, card numbers, credentials, and
numbers, hashes, dates, versions and addresses of pages that are none of these); `labelled_rows` reads another from a table.

Decoding is exact Viterbi, in numpy over whole batches. A token whose score for O exceeds the others
by more than any transitions could make up for is O on every best path; such tokens, by far the
most, cut the text into short stretches, which are decoded together, one position at a time.

Result of `find`: doc_id, char_start, char_end (exclusive, in characters), kind, for each span. Each token is a span;
tokens of one telephone or card number, and of one credential that a slash or an equal sign cut, are one span together.
`redact` replaces each span by its kind in angle brackets and counts n_chars anew.

Defined results: null and empty texts have no spans, and `redact` leaves them as they are; tokens have no
greatest length, all of their characters count; rows are
independent, so repeated rows each give their spans; further columns are ignored by `find` and kept
by `redact`; ids are cast to bigint, and one that is no number is an error; of equally good paths the one with the earlier label (O first) is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm import words as W
from loomtext.llm.tables import small_batches

LABELS = ("O", "EMAIL", "PHONE", "IP", "CARD", "SECRET")
SCHEMA = "doc_id bigint, char_start bigint, char_end bigint, kind string"
_N = len(LABELS)

# --- tokens --------------------------------------------------------------------------------

_PIECE = 255


def _set(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_GAP = W.BLANK | _set("<>\"'`(),;/\\|{}[]&?=")
_ENDS, _BEGINS = _set(".!?*"), _set(".-*#")
_HEX_OR_COLON = _set("0123456789abcdefABCDEF:.%")


def find_tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As words.find_words, with the tokens of the module's docstring."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    gap, cut = _GAP[buf], np.zeros(len(buf) + 1, bool)
    lead = np.flatnonzero(buf >= 0xC2)
    if len(lead):
        padded = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.int64)
        b0, b1, b2 = padded[lead], padded[lead + 1] & 63, padded[lead + 2] & 63
        size = np.where(b0 < 0xE0, 2, np.where(b0 < 0xF0, 3, 4))
        char = np.where(size == 2, (b0 & 31) << 6 | b1, np.where(size == 3, (b0 & 15) << 12 | b1 << 6 | b2, 1 << 17))
        # white space and quotation marks
        blank = np.isin(char, [0x85, 0xA0, 0xAB, 0xBB, 0x1680, 0x2018, 0x2019, 0x201A, 0x201C, 0x201D, 0x201E, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x200B, 0xFEFF]) | ((char >= 0x2000) & (char <= 0x200A))
        for k in range(3):
            at = lead[blank & (size > k)] + k
            gap[at] = True
        # scripts written without blanks: Thai to Myanmar, Khmer, and all from CJK radicals and punctuation on, without the presentation forms of Arabic
        wide = ((char >= 0x0E00) & (char < 0x10A0)) | ((char >= 0x1100) & (char < 0x1200)) | ((char >= 0x1780) & (char < 0x1800)) | ((char >= 0x2E80) & (char < 0xFB00)) | ((char >= 0xFE30) & (char < 0xFE70)) | ((char >= 0xFF00) & (char < 0x10000)) | (size == 4)
        first, behind = lead[wide], (lead + size)[wide]
        cut[first[(first > 0) & (buf[np.maximum(first - 1, 0)] < 128)]] = True
        behind = behind[behind < len(buf)]
        cut[behind[buf[behind] < 128]] = True

    def runs() -> tuple[np.ndarray, np.ndarray]:
        edge = cut.copy()
        edge[off] = True
        inside = ~gap
        begins, ends = edge[:-1].copy(), edge[1:].copy()
        begins[1:] |= gap[:-1]
        ends[:-1] |= gap[1:]
        return np.flatnonzero(inside & begins), np.flatnonzero(inside & ends) + 1

    starts, ends = runs()
    colons = np.flatnonzero(buf == 58)
    if len(colons) and len(starts):
        own = np.searchsorted(starts, colons, side="right") - 1
        other = np.concatenate([[0], np.cumsum(~_HEX_OR_COLON[buf])])
        many = np.bincount(own, minlength=len(starts)) >= 2  # the first colon of a text of its own has own = -1 only where no token begins before it
        whole = many & (other[ends] == other[starts])
        gap[colons[~whole[own]]] = True
        starts, ends = runs()
    for _ in range(3):
        tail = (ends - 1 > starts) & _ENDS[buf[ends - 1]]
        ends = ends - tail
        front = (starts + 1 < ends) & _BEGINS[buf[starts]]
        starts = starts + front
    return starts, ends, np.searchsorted(starts, off)


# --- features ------------------------------------------------------------------------------

#: Classes of bytes; eight counters of one byte each fit a word of 64 bits, for pieces of a token of up to 255 bytes.
_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".", "@", "-", "+", ":", "abcdefABCDEF", "_", "!#$%*^~")
_LUTS = [np.zeros(256, np.uint64), np.zeros(256, np.uint64)]
for _c, _chars in enumerate(_CLASSES):
    for _b in _chars.encode():
        _LUTS[_c // 8][_b] += np.uint64(1 << (8 * (_c % 8)))
_LUTS[1][128:] += np.uint64(1 << 24)  # bytes of other scripts
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32

#: Words that announce something; the last group announces numbers that are not personal.
ANNOUNCING = (
    "password passwd passphrase passcode pwd pass secret token key apikey api_key api-key access_key secret_key private_key client_secret auth_token access_token auth authorization bearer credential credentials",
    "call phone tel telephone mobile cell fax ring sms whatsapp dial text hotline",
    "card visa mastercard amex credit debit cc pan",
    "sha sha1 sha-1 sha256 sha-256 sha512 md5 commit checksum digest hash revision rev isbn issn order invoice version serial ean sku id uuid build release ticket timestamp epoch doi parcel",
)


def _hashes(words: list[str]) -> np.ndarray:
    buf, off = W.buffers(pa.array(words, pa.string()))
    return W.hash_ranges(buf, off[:-1], off[1:], seed=9)


_ANNOUNCED = [np.sort(_hashes(x.split())) for x in ANNOUNCING]


def _count(lut: np.ndarray, buf: np.ndarray) -> np.ndarray:
    total = np.zeros(len(buf) + 1, lut.dtype if lut.dtype != bool else np.int32)
    np.cumsum(lut[buf], out=total[1:])
    return total


def _luhn(buf: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether tokens of 13 to 19 digits and nothing else have the check digit of a card number."""
    k = np.arange(19)
    at = starts[:, None] + size[:, None] - 1 - k[None, :]
    d = np.where(k[None, :] < size[:, None], buf[np.maximum(at, 0)].astype(np.int64) - 48, 0)
    d[:, 1::2] *= 2
    return (np.where(d > 9, d - 9, d).sum(axis=1) % 10) == 0


def shape_codes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The word shape of each token as a bit code; BITS bits. off: where the texts of the slice begin."""
    if not len(starts):
        return np.zeros(0, np.int64)
    # a counter of one byte holds a piece of 255 bytes; the pieces of a token are added up
    pieces = np.maximum((ends - starts + _PIECE - 1) // _PIECE, 1)
    head = np.cumsum(pieces) - pieces
    lo = np.repeat(starts, pieces) + _PIECE * (np.arange(int(pieces.sum())) - np.repeat(head, pieces))
    hi = np.minimum(lo + _PIECE, np.repeat(ends, pieces))
    counts = []
    for lut in _LUTS:
        total = _count(lut, buf)
        counts.append(total[hi] - total[lo])
    n = [((counts[c // 8] >> np.uint64(8 * (c % 8))) & np.uint64(255)).astype(np.int64) for c in range(12)]
    if len(lo) > len(starts):
        n = [np.add.reduceat(x, head) for x in n]
    digit, lower, upper, dot, at, hyphen, plus, colon, hexa, under, mark, other = n
    letter = lower + upper
    size = ends - starts
    first = buf[starts]
    # layout: only few tokens have an @, dots or many digits
    mail, ip4, luhn = np.zeros(len(starts), bool), np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    t = np.flatnonzero((at == 1) & (dot > 0))
    if len(t):
        place = np.arange(len(buf))
        last_at = np.maximum.accumulate(np.where(buf == 64, place, -1))[ends[t] - 1]
        last_dot = np.maximum.accumulate(np.where(buf == 46, place, -1))[ends[t] - 1]
        letters = _count(_set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ-") | (np.arange(256) > 127), buf)
        tail = ends[t] - last_dot - 1
        mail[t] = (last_at > starts[t]) & (last_dot > last_at + 1) & (tail > 1) & (letters[ends[t]] - letters[last_dot + 1] == tail)
    t = np.flatnonzero((dot == 3) & (digit + dot == size) & (digit > 3) & (digit < 13))
    if len(t):
        dots = np.flatnonzero(buf == 46)
        k = np.searchsorted(dots, starts[t])
        edges = np.stack([starts[t] - 1, dots[k], dots[k + 1], dots[k + 2], ends[t]], axis=1)
        part = np.diff(edges, axis=1) - 1
        value = np.zeros(part.shape, np.int64)
        for j in range(3):
            value = np.where(j < part, value * 10 + buf[np.minimum(edges[:, :-1] + 1 + j, len(buf) - 1)].astype(np.int64) - 48, value)
        ip4[t] = ((part > 0) & (part < 4) & (value < 256)).all(axis=1)
    t = np.flatnonzero((digit == size) & (digit > 12) & (digit < 20))
    if len(t):
        luhn[t] = _luhn(buf, starts[t], size[t])
    # the gap before, and the byte behind
    begin = np.zeros(len(starts), np.int64)
    begin[1:] = ends[:-1]
    begin = np.maximum(begin, off[np.searchsorted(off, starts, side="right") - 1])

    def gap_has(chars: str) -> np.ndarray:
        total = _count(_set(chars), buf)
        return total[starts] > total[begin]

    behind = np.where(ends < len(buf), buf[np.minimum(ends, len(buf) - 1)], 0)
    h = W.hash_ranges(_SMALL[buf], starts, np.minimum(ends, starts + 32), seed=9)  # no word of ANNOUNCING is as long
    said = []
    for known in _ANNOUNCED:
        k = np.minimum(np.searchsorted(known, h), len(known) - 1)
        said.append((known[k] == h) & (size < 32))
    only = digit + hyphen + dot + plus == size
    allhex = (digit + hexa == size) & (digit > 0) & (hexa > 0)
    bits = [
        at == 1, at > 1, mail, hyphen > 0, (plus > 0) & (first == 43), under > 0, mark > 0, other > 0,
        dot == 0, dot == 1, dot == 2, dot == 3, dot > 3,
        digit == 0, digit == 1, digit == 2, digit == 3, digit == 4, (digit > 4) & (digit < 7), (digit == 7) | (digit == 8), digit == 9, digit == 10, (digit == 11) | (digit == 12), (digit > 12) & (digit < 20), digit > 19,
        letter == 0, lower > 0, upper > 0, (digit > 0) & (lower > 0), (digit > 0) & (upper > 0) & (lower == 0),
        allhex & (size < 24), allhex & (size > 23) & (size != 32) & (size != 40) & (size != 64), allhex & ((size == 40) | (size == 64)), allhex & (size == 32),
        size < 4, (size > 3) & (size < 12), (size > 11) & (size < 18), (size > 17) & (size < 26), size > 25, size == 20,
        ip4, (colon > 1) & (digit + hexa + colon + dot == size) & ((hexa > 0) | (colon > 2) | (digit < 3)),  # not a time
       
        only & (digit == 10) & (hyphen + dot == 2) & (size == 12), only & (digit == 7) & (hyphen + dot == 1) & (size == 8), only & (digit > 9) & (digit < 16) & (hyphen + dot + plus > 0), (digit == 10) & (size == 10) & (first > 49),
        only & (digit == 16) & (hyphen == 3) & (size == 19), luhn, (digit > 12) & (first > 50) & (first < 55), (digit == 13) & (first == 57), (hyphen == 4) & (size == 36) & (digit + hexa == 32),
        *said,
        gap_has("("), gap_has("=") | gap_has(":"), gap_has("\"'"), gap_has("<"), gap_has("/"), behind == 41, (behind == 58) | (behind == 61),
    ]
    code = np.zeros(len(starts), np.int64)
    for i, b in enumerate(bits):
        code |= b.astype(np.int64) << i
    return code


BITS = 62


def unpack(codes: np.ndarray) -> np.ndarray:
    """Rows of features: the bits, and a constant."""
    return np.concatenate([((codes[:, None] >> np.arange(BITS)) & 1).astype(float), np.ones((len(codes), 1))], axis=1)


# --- the labelled table ------------------------------------------------------------------------

Row = tuple[str, list[tuple[int, int, str]]]  #: a text, and its spans in characters


def labelled_table(rows: int = 1000, seed: int = 6) -> list[Row]:
    """The default training table. The same at every call."""
    rng = np.random.default_rng(seed)
    letters = ["etaoinshrdlucmfwypvbgk", "eaéèêçîoutlrnsimp", "enäöüßrsitdhul", "aeoñíóúrsnldci", "оеаинтсрвлкмд", "的一是不了人我在有他"]
    latin, hexa, caps = "abcdefghijklmnoprstuvwyz", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    pick = lambda x: x[int(rng.integers(len(x)))]
    chars = lambda x, lo, hi: "".join(pick(x) for _ in range(int(rng.integers(lo, hi + 1))))
    digits = lambda n: "".join(str(int(d)) for d in rng.integers(0, 10, n))
    number = lambda lo, hi: str(int(rng.integers(lo, hi)))
    chance = lambda p: rng.random() < p
    end = lambda: pick(["", "", "", "", ".", ",", "!", ";", ":", "?"])
    Part = list[tuple[str, str]]

    def plain() -> Part:
        w = chars(pick(letters), 1, 14) if chance(0.93) else chars(pick(letters), 12, 26)
        r = rng.random() * (1 if len(w) < 12 else 0.6)
        w = w.capitalize() if r < 0.15 else w.upper() if r < 0.25 else w
        return [(w, "O"), (pick(["***", "&&&", "%%%", "$$$", "###", "!!", "...", ")", '"']) if chance(0.12) else end(), "")]

    def harmless() -> Part:
        ver = f"{number(0, 20)}.{number(0, 30)}.{number(0, 30)}"
        isbn = pick([f"97{pick('89')}{digits(10)}", f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"{pick('01')}{digits(8)}{pick('0123456789X')}"])
        date = f"{number(1900, 2100)}-{digits(2)}-{digits(2)}"
        uid = "-".join(chars(hexa, k, k) for k in (8, 4, 4, 4, 12))
        return [(pick([
            digits(int(rng.integers(1, 5))) + end(), f"{digits(1)}.{digits(1)}{end()}", f"{digits(1)}.{digits(1)}.", f"v{ver}", ver, f"version {ver}.{number(0, 90)}", f"release {ver}.{number(0, 90)}", f"{digits(1)}.", f"({digits(4)})", f"{digits(2)}:{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}", date, f"{date}T{digits(2)}:{digits(2)}:{digits(2)}Z", f"{digits(2)}/{digits(2)}/{digits(4)}", f"{digits(2)}.{digits(2)}.{digits(4)}", f"{digits(1)},{digits(3)}", f"{digits(1)},{digits(3)},{digits(3)}", "|", "=", "==", "+", "-", "--", "#", "(see", "e.g.", "i.e.", "a.b", "x=y", "@", "@home", "@name_of_one",
            f"https://{chars(latin, 3, 9)}.org/{chars(latin, 2, 6)}/{chars(latin, 2, 6)}", f"http://www.{chars(latin, 3, 9)}.com/{chars(latin, 2, 6)}?id={digits(int(rng.integers(2, 8)))}", f"www.{chars(latin, 3, 9)}.{pick(['org', 'de', 'net'])}", f"{chars(latin, 3, 9)}.{pick(['com', 'py', 'txt', 'html'])}", "U.S.A.", "(c)", "C-3", "A4", "B12", digits(6), digits(8), f"{digits(3)}-{digits(3)}", f"{number(1800, 2030)}-{number(1800, 2030)}", f"{number(10, 999)}-{number(10, 999)}", f"{digits(3)}-{digits(4)}",
            "the token", "a password", "password", "my password is", "the secret of", "call", "please call", "a card", "the key to", "text", "key", "secret", "token", "credit", "***", "[1]", f"{digits(2)}%", f"${digits(3)}", f"{digits(3)}.{digits(2)}", f"-{digits(1)}.{digits(4)}", "co-op", "state-of-the-art", "snake_case", '"quoted"', "'s",
            f"{pick(['ISBN', 'ISBN:', 'isbn', 'ISBN-13:', 'EAN'])} {isbn}", f"97{pick('89')}{digits(10)}", f"ISBN 978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"{pick(['sha256:', 'SHA-256 ', 'checksum: ', 'digest ', 'sha256='])}{chars(hexa, 64, 64)}", f"{pick(['commit ', 'sha1 ', 'revision ', 'sha1:', 'hash '])}{chars(hexa, 40, 40)}", f"{pick(['md5 ', 'md5: ', 'md5:', 'hash '])}{chars(hexa, 32, 32)}", chars(hexa, 64, 64), f"commit {chars(hexa, 7, 12)}", uid, f"uuid {uid}",
            f"{pick(['order', 'Order', 'ticket', 'invoice', 'id', 'serial'])} {pick(['', '#'])}{digits(int(rng.integers(5, 13)))}", f"{pick(['timestamp', 'epoch'])} 1{digits(9)}", f"1{digits(9)}", f"id={digits(int(rng.integers(4, 17)))}", f"doi:10.{digits(4)}/{chars(latin, 3, 6)}.{digits(5)}", f"{digits(3)}x{digits(3)}", f"{chars(caps, 2, 4)}-{digits(4)}", chars(caps, 10, 18),
        ]), "O")]

    def wrapped(x: str, kind: str) -> Part:
        a, b = pick([("", end()), ("", end()), ("", end()), ("<", ">"), ("(", ")"), ('"', '"'), ("'", "'"), ("[", "]"), ("(", ").")])
        return [(a, ""), (x, kind), (b, "")]

    def email() -> Part:
        part = lambda: chars(latin, 2, 9)
        name = pick([part(), part(), f"{part()}.{part()}", f"{part()}.{digits(2)}", f"{part()}_{part()}", f"{part()}-{part()}", part() + digits(int(rng.integers(1, 5))), f"{part()}+{part()}", f"{part()}.{part()}+{digits(2)}", chars(latin, 1, 1) + part(), chars(latin, 1, 1) + "." + part()])
        tld = pick(["com", "org", "net", "de", "io", "fr", "co.uk", "edu", "info", "example", "museum", "es", "gov", "dev"])
        host = pick([part(), part(), part(), f"{part()}.{part()}", f"{part()}{digits(1)}.{part()}", f"{part()}-{part()}", f"mail.{part()}.{part()}"])
        x = f"{name}@{host}.{tld}"
        x = x.upper() if chance(0.12) else x.title() if chance(0.08) else x
        return pick([wrapped, wrapped, wrapped, lambda v, k: [("mailto:", "O"), (v, k), (end(), "")], lambda v, k: [(pick(["email:", "E-mail: ", "mail=", "to: ", "from:", "contact: "]), "O"), (v, k), (end(), "")]])(x, "EMAIL")

    def phone() -> Part:
        a, b, c, s = digits(3), digits(3), digits(4), pick("-. ")
        cc = pick(["1", "44", "49", "33", "34", "7", "91", "353"])
        x, announced = pick([
            (f"+{pick('1234')} ({a}) {b}-{c}", False), (f"({a}) {b}-{c}", False), (f"({a}){b}-{c}", False), (f"{a}{s}{b}{s}{c}", s == " "), (f"{a}-{b}-{c}", False), (f"{a}.{b}.{c}", False), (f"+1 {a}-{b}-{c}", False), (f"+1-{a}-{b}-{c}", False), (f"1-{a}-{b}-{c}", False), (f"+1.{a}.{b}.{c}", False), (f"+1 {a} {b} {c}", False), (f"+{cc}{digits(int(rng.integers(9, 11)))}", False), (f"+{cc} {digits(2)} {digits(4)} {digits(4)}", False), (f"+{cc} {digits(3)} {digits(6)}", False), (f"+{cc} {digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", False), (f"+{cc} ({digits(1)}) {digits(2)} {digits(4)} {digits(4)}", False), (f"0{digits(3)} {digits(6)}", True), (f"0{digits(2)}-{digits(4)}-{digits(4)}", False), (f"{pick('23456789')}{digits(9)}", chance(0.7)), (f"{b}-{c}", True), (f"0{digits(10)}", True),
        ])
        lead = pick(["call ", "Tel. ", "tel: ", "phone ", "Phone: ", "mobile ", "fax ", "call me at ", "tel:", "text ", "Call: "]) if announced or chance(0.35) else pick(["", "", "(", ""])
        return [(lead, "O"), (x, "PHONE"), (")" if lead == "(" else end(), "")]

    def ip() -> Part:
        four = pick([".".join(number(1, 255) for _ in range(4)), ".".join(number(1, 255) for _ in range(4)), ".".join(number(1, 100) for _ in range(4)), f"10.{number(0, 20)}.{number(0, 9)}.{number(1, 99)}", f"192.168.{number(0, 9)}.{number(1, 255)}", "127.0.0.1", ".".join(number(1, 12) for _ in range(4))])
        group = lambda: chars(hexa, 1, 4)
        six = pick([":".join(group() for _ in range(8)), f"2001:db8::{group()}", f"fe80::{group()}:{group()}:{group()}:{group()}", f"{group()}:{group()}::{group()}:{group()}", f"{group()}:{group()}:{group()}::{group()}", f"::ffff:{group()}"])
        if chance(0.3):
            return [("[" if chance(0.3) else "", ""), (six.upper() if chance(0.2) else six, "IP"), (pick(["", "", ",", "]", " "]), "")]
        return pick([
            [(four, "IP"), (end(), "")], [(four, "IP"), (end(), "")], [("(", ""), (four, "IP"), (")", "")], [(pick(["http://", "https://", "ftp://"]), "O"), (four, "IP"), (pick(["/", "/x/y", f":{digits(4)}/x", f":{digits(4)}", "/index.html"]), "O")],
            [(four, "IP"), (f":{digits(int(rng.integers(2, 5)))}", "O")], [(pick(["ip=", "IP: ", "host ", "from ", "ip "]), "O"), (four, "IP"), (end(), "")], [(four, "IP"), ("/24", "O")],
        ])

    def card() -> Part:
        n = pick([16, 16, 16, 16, 15, 13, 19])
        x = (pick("3456") if chance(0.8) else pick("0125789")) + digits(n - 1)
        if n == 13:
            x = "4" + x[1:]
        if chance(0.3):
            odd = sum(sum(divmod(int(v) * (1 + k % 2), 10)) for k, v in enumerate(reversed(x[:-1] + "0")))
            x = x[:-1] + str(-odd % 10)
        if n == 16 and chance(0.45):
            x = pick(" -").join(x[i : i + 4] for i in range(0, 16, 4))
        if n == 15 and chance(0.4):
            x = f"{x[:4]} {x[4:10]} {x[10:]}"
        return [(pick(["card ", "Card: ", "visa ", "card number ", "credit card ", "cc "]) if chance(0.4) else "", "O"), (x, "CARD"), (end(), "")]

    def secret() -> Part:
        code = chars(hexa, 28, 48)
        mixed = chars(latin + caps + "0123456789", 20, 44)
        weak = chars(latin + "0123456789", 6, 14) + pick(["", "!", digits(2), "#1"])
        strong = chars(latin + caps + "0123456789!$%*_-", 8, 20)
        name = pick(["password", "pwd", "secret", "api_key", "API_KEY", "token", "Password", "passwd", "access_token", "client_secret", "key", "apikey"])
        return pick([
            [(pick(["", "", "id ", "key id ", "key: "]), "O"), ("AK" + pick(["IA", "ID", "XZ"]) + chars(pick([caps + "234567", caps]), 16, 16), "SECRET"), (end(), "")], [(chars(caps, 4, 4) + chars(caps + "0123456789", 14, 20) + digits(1), "SECRET"), (end(), "")],
            [(f"{pick(['token', 'key', 'secret'])} = \"", "O"), (code, "SECRET"), ('"', "")], [(f"{name}=", "O"), (pick([code, mixed, weak, strong]), "SECRET"), ("", "")], [(f"{name}: ", "O"), (pick([code, mixed, weak, strong]), "SECRET"), (pick(["", "", ","]), "")], [(f"{name}='", "O"), (pick([code, mixed, weak, strong]), "SECRET"), ("'", "")], [(f'"{name}": "', "O"), (pick([code, mixed, weak, strong]), "SECRET"), ('",', "")],
            [("Bearer ", "O"), (mixed, "SECRET"), ("", "")], [("", ""), (pick(["ghp_", "sk_live_", "xoxb-", "glpat-"]) + chars(latin + caps + "0123456789", 20, 36), "SECRET"), (end(), "")], [(chars(hexa, 44, 56), "SECRET"), ("", "")],
        ])

    kinds = [email, email, phone, phone, ip, card, secret]
    table = []
    for i in range(rows):
        parts = [(harmless if chance(0.3) else plain)() for _ in range(int(rng.integers(3, 12)))]
        for _ in range(int(rng.integers(0, 4)) if i % 3 else 0):
            at = int(rng.integers(len(parts) + 1))
            parts[at:at] = [pick(kinds)(), plain()]
        text, spans = "", []
        for part in parts:
            if text:
                text += pick([" ", " ", " ", " ", "\n"]) if not text.endswith(("的", "了", "人")) or chance(0.5) else ""
            for x, kind in part:
                if kind not in ("", "O"):
                    spans.append((len(text), len(text) + len(x), kind))
                text += x
        table.append((text, spans))
    return table


def labelled_rows(table: DataFrame, most: int = 20_000) -> list[Row]:
    """The rows of a table (text, spans: array of struct (start, end, kind)) to fit on; of larger tables about
    `most` of them, by hash of the text, as a model of this size needs no more."""
    rows = table.filter("text IS NOT NULL").select("text", "spans")
    n = rows.count()
    if n > most:
        rows = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.lit((1 << 30) * most // n))
    return [(r["text"], [(s["start"], s["end"], s["kind"]) for s in r["spans"] or []]) for r in rows.collect()]


def tokens_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, first characters, last + 1) of the tokens of one text."""
    buf, off = W.buffers(pa.array([text], pa.string()))
    starts, ends, _ = find_tokens(buf, off)
    chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    return shape_codes(buf, starts, ends, off), chars[starts], chars[ends]


def token_labels(lo: np.ndarray, hi: np.ndarray, spans: list[tuple[int, int, str]]) -> np.ndarray:
    y = np.zeros(len(lo), np.int64)
    for a, b, kind in spans:
        y[(lo < b) & (hi > a)] = LABELS.index(kind)
    return y


# --- the model -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    own: np.ndarray  #: weights of a token's features, (BITS + 1, labels)
    before: np.ndarray  #: of the features of the token before
    after: np.ndarray
    step: np.ndarray  #: transitions

    def emissions(self, codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Scores of all labels of each token; doc: the text of each token."""
        uniq, at = np.unique(codes, return_inverse=True)
        x = unpack(uniq)
        out = (x @ self.own)[at]
        if len(codes) > 1:
            same = doc[1:] == doc[:-1]
            out[1:] += (x @ self.before)[at[:-1]] * same[:, None]
            out[:-1] += (x @ self.after)[at[1:]] * same[:, None]
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def forward(e: np.ndarray, mask: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(forward scores, log of the partition function) of sequences; e: (sequence, place, label)."""
    alpha = np.zeros_like(e)
    alpha[:, 0] = e[:, 0]
    for k in range(1, e.shape[1]):
        new = _logsum(alpha[:, k - 1, :, None] + step, 1) + e[:, k]
        alpha[:, k] = np.where(mask[:, k, None], new, alpha[:, k - 1])
    return alpha, _logsum(alpha[:, -1], 1)


def expectations(e: np.ndarray, mask: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities of labels, expected number of each transition)."""
    alpha, z = forward(e, mask, step)
    beta = np.zeros_like(e)
    for k in range(e.shape[1] - 2, -1, -1):
        new = _logsum(step[None] + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
        beta[:, k] = np.where(mask[:, k + 1, None], new, 0)
    post = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
    move = alpha[:, :-1, :, None] + step + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
    return post, np.exp(np.where(mask[:, 1:, None, None], move, -np.inf)).sum(axis=(0, 1))


def fit(table: list[Row], steps: int = 120, rate: float = 0.1, penalty: float = 2e-4) -> Model:
    """Maximises the penalised log-likelihood of the table by Adam, over all rows at every step."""
    made = []
    for text, marked in table:
        codes, lo, hi = tokens_of(text)
        if len(codes):
            made.append((codes, token_labels(lo, hi, marked)))
    if not made:
        raise ValueError("the labelled table has no tokens")
    n, most = len(made), max(len(c) for c, _ in made)
    size = np.array([len(c) for c, _ in made])
    uniq = np.unique(np.concatenate([c for c, _ in made]))
    x = np.concatenate([unpack(uniq), np.zeros((1, BITS + 1))])  # the last stands outside the sentences
    at = np.full((n, most + 2), len(uniq))
    y = np.zeros((n, most), np.int64)
    for i, (codes, labels) in enumerate(made):
        at[i, 1 : len(codes) + 1] = np.searchsorted(uniq, codes)
        y[i, : len(codes)] = labels
    mask = np.arange(most)[None, :] < size[:, None]
    places = at[:, 1:-1], at[:, :-2], at[:, 2:]
    x = x.astype(np.float32)  # half the time, and enough for gradients
    w = [np.zeros((BITS + 1, _N), np.float32) for _ in range(3)] + [np.zeros((_N, _N), np.float32)]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    gold = (np.eye(_N)[y] * mask[..., None]).astype(np.float32)
    pairs = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    for t in range(1, steps + 1):
        e = sum((x @ a)[p] for a, p in zip(w, places, strict=False))
        post, expected = expectations(e, mask, w[3])
        gap = gold - post
        grads = [x.T @ np.stack([np.bincount(p.ravel(), weights=gap[..., c].ravel(), minlength=len(x)) for c in range(_N)], axis=1).astype(np.float32) / n for p in places] + [(pairs - expected) / n]
        for i, g in enumerate(grads):
            g = g - penalty * w[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            w[i] = w[i] + rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Model(*[a.astype(float) for a in w])


@lru_cache
def default_model() -> Model:
    return fit(labelled_table())


def viterbi(e: np.ndarray, doc: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The best labels of all tokens; doc: the text of each token, which is a chain of its own."""
    n = len(e)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    # what a label other than O could gain by transitions, at most
    gain = np.maximum((step - step[:, :1]).max(axis=0), 0) + np.maximum((step - step[:1]).max(axis=1), 0)
    open_ = (e[:, :1] - e <= gain)[:, 1:].any(axis=1)
    at = np.flatnonzero(open_)
    if not len(at):
        return out
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])
    first = at[new]
    size = np.diff(np.append(np.flatnonzero(new), len(at)))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    inside = (first > 0) & (doc[np.maximum(first - 1, 0)] == doc[first])  # after a token that is O
    best = e[first] + np.where(inside[:, None], step[0][None], 0)
    back: list[np.ndarray] = []
    final = np.zeros((len(first), _N))
    k = 0
    while True:
        done = int(np.searchsorted(-size, -(k + 1), side="left"))  # stretches longer than k + 1
        final[done : len(best)] = best[done:]
        best = best[:done]
        if not done:
            break
        k += 1
        move = best[:, :, None] + step[None]
        back.append(move.argmax(axis=1))
        best = move.max(axis=1) + e[first[:done] + k]
    last = first + size - 1
    follow = (last + 1 < n) & (doc[np.minimum(last + 1, n - 1)] == doc[last])
    final = final + np.where(follow[:, None], step[:, 0][None], 0)
    label = final.argmax(axis=1)
    for k in range(int(size[0]) - 1, -1, -1):
        live = int(np.searchsorted(-size, -k, side="left"))  # stretches longer than k
        out[first[:live] + k] = label[:live]
        if k:
            label[:live] = back[k - 1][np.arange(live), label[:live]] if len(back[k - 1]) >= live else label[:live]
    return out


#: What may stand between tokens of one span, by kind; an empty set keeps them apart.
_BETWEEN = [_set(""), _set(""), _set(" ().-/\t"), _set(""), _set(" -"), _set("/=")]
_CLOSE = 3


def spans(texts: pa.Array, model: Model) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice that has any: rows, and (text, first character, last + 1, label) of its spans."""
    for i, j, buf, off in W.text_slices(texts):
        starts, ends, ptr = find_tokens(buf, off)
        doc = np.repeat(np.arange(j - i), np.diff(ptr))
        label = viterbi(model.emissions(shape_codes(buf, starts, ends, off), doc), doc, model.step) if len(starts) else np.zeros(0, np.int64)
        hit = np.flatnonzero(label)
        if not len(hit):
            continue
        new = np.ones(len(hit), bool)
        same = (hit[1:] == hit[:-1] + 1) & (doc[hit[1:]] == doc[hit[:-1]]) & (label[hit[1:]] == label[hit[:-1]])
        for k in np.flatnonzero(same):
            between = buf[ends[hit[k]] : starts[hit[k + 1]]]
            new[k + 1] = len(between) > _CLOSE or not _BETWEEN[label[hit[k]]][between].all()
        a = np.flatnonzero(new)
        z = np.append(a[1:], len(hit)) - 1
        lo, hi = starts[hit[a]].copy(), ends[hit[z]].copy()
        kind, d = label[hit[a]], doc[hit[a]]
        before = np.maximum(lo - 1, 0)
        lo[(kind == 2) & (lo > off[d]) & (buf[before] == 40) & (a < z)] -= 1  # the bracket of an area code
        chars = np.zeros(len(buf) + 1, np.int64)
        np.cumsum((buf & 0xC0) != 0x80, out=chars[1:])
        base = chars[off[:-1]][d]
        yield i, j, d, chars[lo] - base, chars[hi] - base, kind


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """All spans of `docs` (doc_id, text): see SCHEMA."""
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(LABELS)
        for b in batches:
            for i, j, d, lo, hi, label in spans(b.column(1), shared.value):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).take(pa.array(d)), pa.array(lo), pa.array(hi), pa.array(names[label], pa.string())], ["doc_id", "char_start", "char_end", "kind"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """`docs` with the spans in its column text replaced; n_chars, where there is such a column, follows."""
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model or default_model())

    @F.pandas_udf("string")
    def clean(text):  # noqa: ANN001, ANN202
        arr = pa.array(text, pa.string(), from_pandas=True)
        out = text.copy()
        for i, _, d, lo, hi, label in spans(arr, shared.value):
            for k in np.unique(d):
                t, parts, at = text.iloc[i + k], [], 0
                for x in np.flatnonzero(d == k):
                    parts += [t[at : lo[x]], f"<{LABELS[label[x]]}>"]
                    at = hi[x]
                out.iloc[i + k] = "".join([*parts, t[at:]])
        return out

    new = docs.withColumn("text", clean("text"))
    return new.withColumn("n_chars", F.when(F.col("n_chars").isNull(), None).otherwise(F.length("text")).cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else new
