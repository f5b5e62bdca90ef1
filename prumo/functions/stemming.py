"""Portuguese suffix stripping after the published Snowball description.

Works on distinct words of a batch; the caller runs it inside an Arrow UDF.
"""

from __future__ import annotations

VOWELS = "aeiouáéíóúâêô"

# Suffixes by what happens to them, as published.
REMOVE = (
    "amentos imentos amento imento adoras adores aço~es ezas icos icas ismos istas osos osas adora aça~o "
    "antes ância ante eza ico ica ismo ável ível ista oso osa ador"
).split()
VERB = (
    "aríamos eríamos iríamos ássemos êssemos íssemos aríeis eríeis iríeis ásseis ésseis ísseis áramos "
    "éramos íramos ávamos aremos eremos iremos ariam eriam iriam assem essem issem arias erias irias "
    "ardes erdes irdes asses esses isses astes estes istes áreis areis éreis ereis íreis ireis áveis "
    "íamos armos ermos irmos aria eria iria asse esse isse aste este iste arei erei irei adas idas aram "
    "eram iram avam arem erem irem ando endo indo ara~o era~o ira~o arás aras erás eras irás avas ares "
    "eres ires íeis ados idos ámos amos emos imos iras ada ida ará ara erá era irá ava iam ado ido ias "
    "ais eis ira ia ei am em ar er ir as es is eu iu ou"
).split()
RESIDUAL = "os a i o á í ó".split()


def regions(word: str) -> tuple[int, int, int]:
    """Start of RV, R1 and R2."""

    def after(start: int) -> int:
        for i in range(start + 1, len(word)):
            if word[i] not in VOWELS and word[i - 1] in VOWELS:
                return i + 1
        return len(word)

    r1 = after(0)
    r2 = after(r1) if r1 < len(word) else len(word)
    rv = len(word)
    if len(word) > 2:
        if word[1] not in VOWELS:
            rv = next((i + 1 for i in range(2, len(word)) if word[i] in VOWELS), len(word))
        elif word[0] in VOWELS:
            rv = next((i + 1 for i in range(2, len(word)) if word[i] not in VOWELS), len(word))
        else:
            rv = 3
    return rv, r1, r2


def longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _standard(word: str, r1: int, r2: int, rv: int) -> str:
    """One of the noun and adjective endings, or the word unchanged."""
    groups = {
        "amente": "amente", "mente": "mente", "logia": "log", "logias": "log",
        "uça~o": "u", "uço~es": "u", "ência": "ente", "ências": "ente",
        "idade": "idade", "idades": "idade", "iva": "iv", "ivo": "iv", "ivas": "iv", "ivos": "iv",
        "ira": "ir", "iras": "ir",
    }
    suffix = longest(word, [*REMOVE, *groups])
    if not suffix:
        return word
    at = len(word) - len(suffix)
    stem = word[:at]

    def drop(text: str, *endings: str) -> str:
        """Remove the longest of the endings if it lies in R2."""
        end = longest(text, endings)
        return text[: -len(end)] if end and len(text) - len(end) >= r2 else text

    if suffix in REMOVE:
        return stem if at >= r2 else word
    if suffix == "amente":
        if at < r1:
            return word
        if stem.endswith("iv") and at - 2 >= r2:
            return drop(stem[:-2], "at")
        return drop(stem, "os", "ic", "ad")
    if at < r2 and suffix not in ("ira", "iras"):
        return word
    if suffix == "mente":
        return drop(stem, "ante", "avel", "ível")
    if suffix in ("idade", "idades"):
        return drop(stem, "abil", "ic", "iv")
    if groups[suffix] == "iv":
        return drop(stem, "at")
    if suffix in ("ira", "iras"):
        return stem + "ir" if at >= rv and stem.endswith("e") else word
    return stem + groups[suffix]


def stem_pt(word: str) -> str:
    word = word.replace("ã", "a~").replace("õ", "o~")
    rv, r1, r2 = regions(word)
    new = _standard(word, r1, r2, rv)
    if new == word:
        suffix = longest(word, [s for s in VERB if len(word) - len(s) >= rv])
        new = word[: len(word) - len(suffix)] if suffix else word
    if new != word:
        if new.endswith("ci") and len(new) - 1 >= rv:
            new = new[:-1]
    else:
        suffix = longest(word, RESIDUAL)
        if suffix and len(word) - len(suffix) >= rv:
            new = word[: -len(suffix)]
    if new[-1:] in ("e", "é", "ê") and len(new) - 1 >= rv:
        new = new[:-1]
        for before in ("gu", "ci"):
            if new.endswith(before) and len(new) - 1 >= rv:
                new = new[:-1]
                break
    elif new.endswith("ç"):
        new = new[:-1] + "c"
    return new.replace("a~", "ã").replace("o~", "õ")
