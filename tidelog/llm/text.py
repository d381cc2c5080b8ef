"""Plain words and sentences of dirty texts."""

from __future__ import annotations

import html
import re
import unicodedata

# Characters that UTF-8 continuation bytes turn into when read as Windows-1252.
_TAIL = "[\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"
_BROKEN = re.compile(f"[ÂÃÄÅã]{_TAIL}|â{_TAIL}{{2}}")
#: Markup of any length: a sign < that a name, a slash, ! or ? follows. A comparison (a < b) is text.
_TAG = re.compile(r"<[A-Za-z/!?][^<>]*>")
_BREAK = re.compile(r"<br\s*/?>", re.IGNORECASE)
_OTHER = re.compile("[^\x00-\x7f]")
_CJK = re.compile("[぀-ヿ㐀-鿿ｦ-ﾟ]")
_LETTER = re.compile(r"[^\W_]")


class _Plain(dict):
    """What a character beyond ASCII becomes: lower case without accents; nothing for marks and format characters; a blank for what is no
    letter or digit. Made when first asked for."""

    def __missing__(self, c: str) -> str:
        found = [x for x in unicodedata.normalize("NFKD", c.casefold()).lower() if unicodedata.category(x) not in ("Mn", "Cf")]
        self[c] = "".join(x if x.isascii() or x.isalnum() else " " for x in found)
        return self[c]


_PLAIN = _Plain({"。": ".", "…": " "})
_ENDS = b".!?;\n\r"
#: Lower case; all that is no letter or digit is a blank. With ends: sentence ends are line ends.
_WORDS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in (ord(chr(b).lower()) if b < 128 else b for b in range(256)))
_SENTENCES = bytes(10 if b in _ENDS else _WORDS[b] for b in range(256))


def _whole(m: re.Match) -> str:
    broken = m[0].replace("ã", "Ã")  # put in lower case after it broke
    for code in ("cp1252", "latin-1"):
        try:
            return broken.encode(code).decode("utf-8")
        except UnicodeError:
            pass
    return m[0]


def clean(text: str | None) -> str:
    """Entities resolved, UTF-8 that was read as Windows-1252 mended, tags dropped. Null is the empty text."""
    if not text:
        return ""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if not text.isascii():
        text = _BROKEN.sub(_whole, text)
    return _TAG.sub(" ", text) if "<" in text else text


def _plain(text: str, table: bytes) -> bytes:
    if not text.isascii():
        text = _OTHER.sub(lambda m: _PLAIN[m[0]], text)
    return text.encode("utf-8", "replace").translate(table)


def word_bytes(text: str | None) -> list[bytes]:
    """words() in UTF-8, which costs less."""
    return _plain(clean(text), _WORDS).split()


def words(text: str | None) -> list[str]:
    """Words in lower case without accents, marks, punctuation and markup."""
    return [w.decode() for w in word_bytes(text)]


def sentence_bytes(text: str | None) -> list[list[bytes]]:
    """Words of each sentence in UTF-8; sentences end at . ! ? ; line ends and breaks."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "<" in text:
        text = _BREAK.sub("\n", text)
    return [w for s in _plain(clean(text), _SENTENCES).split(b"\n") if (w := s.split())]


def mostly_cjk(text: str | None) -> bool:
    """Whether Chinese or Japanese characters are at least a third of all letters."""
    if not text or text.isascii():
        return False
    some = len(_CJK.findall(text))
    return some > 0 and 3 * some >= len(_LETTER.findall(text))
