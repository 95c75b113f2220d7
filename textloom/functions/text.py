"""Text functions: Column -> Column, in the JVM but for Unicode normal forms.

Lengths and places are in code points. Spaces, letters and word characters are
Unicode's, as the patterns below spell out for Java.
"""

import unicodedata
from collections.abc import Callable
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
UNICODE = "(?U)"

# Words that mark one language, and letters of it; each word counts wherever it stands alone.
GERMAN = "und|nicht|ignoriere|anweisunge|anweisungen|vorherigen|deine|bitte|ich|sind|welche|wird|werden|gibt|gegen|dagegen|unsere|möchte|keine|schon|jetzt|warum|wenn|haben|für|wie"
FRENCH = "ignorez|précédentes|veuillez|vôtre|vous|avec|cette|sont|aussi|mais|les|des|est|une"
TURKISH = "talimat|unut|önceki|yoksay|için|değil|daha|nasil|neden|lütfen|hesap|mesaj|bir|ve"
GERMAN_LETTERS, FRENCH_LETTERS, TURKISH_LETTERS = "[äöüßÄÖÜ]", "[àâçéèêëîïôûù]", "[ğışĞİŞ]"
SCRIPTS = (("zh", "[　-鿿]"), ("ru", "[Ѐ-ӿ]"), ("ar", "[؀-ۿ]"))
SCRIPT_SHARE = 0.30

# Wording that benign texts share with injections; each counts anywhere in the lower-cased text.
FP_HARD_WORDS = (
    "ignore", "disregard", "forget", "override", "instruction", "instructions", "system prompt", "verify", "confirm", "password", "api key", "api-key",
    "token", "credential", "reveal", "print your", "repeat the", "as an ai", "you are now", "prompt", "jailbreak", "username", "verification code", "login",
    "ignoriere", "passwort", "kennwort", "bestätigen", "bestätige", "anweisung", "zugangsdaten", "überprüfen", "bestätigungscode",
    "ignorez", "ignorer", "mot de passe", "confirmez", "vérifiez", "identifiant", "consigne", "code de vérification",
    "şifre", "parola", "doğrula", "doğrulama", "onayla", "talimat", "yoksay", "kullanıcı adı",
    "lozinka", "potvrdi", "zanemari", "uputstvo", "prijava",
    "contraseña", "credenciales", "istruzioni", "credenziali", "senha", "instruções", "wachtwoord", "negeer", "hasło", "zignoruj", "potwierdź",
)

# The markers of the keyword baseline.
BASELINE_MARKERS = (
    "ignore previous", "ignore all previous", "disregard previous", "forget all previous", "you are now", "system prompt", "reveal your",
    "print your", "as an ai", "new task:", "before completing", "before finishing", "you must", "send patient", "exfiltrate",
)

# Names of languages in source metadata and their codes.
LANGUAGE_CODES = {
    "English": "en", "German": "de", "French": "fr", "Spanish": "es", "Italian": "it", "Portuguese": "pt", "Dutch": "nl", "Polish": "pl", "Swedish": "sv", "Czech": "cs",
    "Russian": "ru", "Chinese": "zh", "Arabic": "ar", "Hindi": "hi", "Japanese": "ja", "Korean": "ko", "Thai": "th",
}
LATIN_CODES = ("en", "de", "fr", "es", "it", "pt", "nl", "pl", "sv", "cs")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it occurs."""
    return F.transform(F.array(value), use)[0]


def holds_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the lower-cased text holds one of the words anywhere. A word that holds another one adds nothing."""
    least = [w for w in dict.fromkeys(words) if not any(v != w and v in w for v in words)]
    return let(F.lower(text), lambda low: reduce(or_, [F.contains(low, F.lit(w)) for w in least]))


def normal_form(form: str):
    """A function that brings a column into a Unicode normal form; null stays null."""

    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: unicodedata.normalize(form, x), na_action="ignore")

    return apply


def in_form(text: Column, form: str) -> Column:
    """NFC or NFKC. Only texts that may not be in it already are sent to Python: others are sent as null."""
    simple = "^[\\u0000-\\u02ff]*\\z" if form == "NFC" else "^[\\u0000-\\u009f]*\\z"
    return F.coalesce(normal_form(form)(F.when(~text.rlike(simple), text)), text)


def strip(text: Column) -> Column:
    # the end is looked for from a run's first place only, and a run is never given back: linear in long runs
    return F.regexp_replace(text, rf"{UNICODE}\A{SPACE}++|(?<!{SPACE}){SPACE}++\z", "")


def norm_text(text: Column, nfc: bool = True) -> Column:
    """NFC, line ends as \\n, runs of blanks as one, at most one empty line, no space at the ends. Zero-width and look-alike letters stay."""
    text = in_form(text, "NFC") if nfc else text
    text = F.regexp_replace(text, r"\r\n|\r", "\n")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def dedup_key(text: Column) -> Column:
    """SHA-1 of the text without regard to case and the amount of space."""
    # runs first, so one space at most is left at either end
    return F.sha1(F.trim(F.regexp_replace(F.lower(text), rf"{UNICODE}{SPACE}++", " ")))


def hash_bucket(text: Column, modulo: int) -> Column:
    """The first eight hex digits of the SHA-1, as a number, modulo."""
    return F.conv(F.substring(F.sha1(text), 1, 8), 16, 10).cast("bigint") % modulo


def word_hits(words: Column, which: str) -> Column:
    """How many of an array of lower-case words are among those given."""
    return F.size(F.filter(words, lambda w: w.isin(*which.split("|"))))


def guess_lang(text: Column) -> Column:
    """A language from script, marked letters and function words, where one dominates; else en."""
    count = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))  # noqa: E731  each match is one character
    letters = F.greatest(count(r"[\p{L}\p{Nl}\p{No}]+"), F.lit(1))
    script = let(letters, lambda n: F.coalesce(*[F.when(count(f"{p}+") / n >= SCRIPT_SHARE, code) for code, p in SCRIPTS]))
    script = F.when(text.rlike("|".join(p for _, p in SCRIPTS)), script)  # most texts have no such letter, and none are counted
    n_words = F.greatest(F.size(F.array_remove(F.split(text, rf"{UNICODE}{SPACE}+"), "")), F.lit(1))
    need = F.greatest(F.when(F.length(text) < 80, 2).otherwise(3), F.floor(F.lit(0.04).cast("double") * n_words).cast("int"))
    # four letters that other tables of Unicode write alike in lower case
    tokens = F.split(F.lower(F.translate(text, "İı\u017f\u212a", "iisk")), r"[^\p{L}\p{N}_]+")
    tokens = F.filter(tokens, lambda w: w.isin(*dict.fromkeys("|".join((TURKISH, GERMAN, FRENCH)).split("|"))))
    points = let(tokens, lambda w: F.struct((2 * count(TURKISH_LETTERS) + word_hits(w, TURKISH)).alias("tr"), (count(GERMAN_LETTERS) + word_hits(w, GERMAN)).alias("de"), (count(FRENCH_LETTERS) + word_hits(w, FRENCH)).alias("fr")))
    best = let(F.struct(points.alias("p"), need.alias("need")), lambda s: F.when(F.greatest(s["p"]["tr"], s["p"]["de"], s["p"]["fr"]) < s["need"], "en").when((s["p"]["tr"] >= s["p"]["de"]) & (s["p"]["tr"] >= s["p"]["fr"]), "tr").when(s["p"]["de"] >= s["p"]["fr"], "de").otherwise("fr"))
    return F.coalesce(script, best, F.lit("en"))


def is_fp_hard(text: Column) -> Column:
    return holds_any(text, FP_HARD_WORDS)


def baseline_predict(text: Column) -> Column:
    return F.when(holds_any(text, BASELINE_MARKERS), "injection").otherwise("benign")


def pre_tokenize(text: Column, nfkc: bool = True) -> Column:
    """Words in lower case; each ASCII punctuation mark is a word."""
    text = in_form(text, "NFKC") if nfkc else text
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{Punct}|[^\s\x0b\x1c-\x1f\x85\p{Z}\p{Punct}]+"), F.lit(0))


def is_cjk(char: Column) -> Column:
    return char.rlike("^[一-鿿぀-ヿ가-힯]")


def snippet(text: Column, chars: int = 200) -> Column:
    """The first characters, runs of space as one blank."""
    return F.substring(strip(F.regexp_replace(text, rf"{UNICODE}{SPACE}+", " ")), 1, chars)


def fill(template: Column, slots: dict[str, Column]) -> Column:
    """The template with each {name} replaced, one after the other."""
    for name, value in slots.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def language_code(name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGE_CODES.items() for x in kv]), name)


def subject_and_body(subject: Column, body: Column) -> Column:
    return strip(F.when(F.coalesce(subject, F.lit("")) != "", F.concat_ws("\n", subject, F.coalesce(body, F.lit("")))).otherwise(F.coalesce(body, F.lit(""))))


def literal_to_json(value: Column) -> Column:
    """Python literals as JSON; null where they are none."""
    import ast
    import json

    def one(x):
        try:
            return json.dumps(ast.literal_eval(x), ensure_ascii=False)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None

    @F.pandas_udf("string")
    def apply(values: pd.Series) -> pd.Series:
        return values.map(one, na_action="ignore")

    return apply(value)


def parse_record(value: Column, schema: str) -> Column:
    """A struct from JSON, or from a Python literal where it is no JSON."""
    strict = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}
    broken = F.from_json(value, f"{schema}, _bad string", strict | {"columnNameOfCorruptRecord": "_bad"})
    text = F.when(broken["_bad"].isNotNull(), literal_to_json(F.when(broken["_bad"].isNotNull(), value))).otherwise(value)
    return F.from_json(text, schema)


def parse_quoted_json(value: Column, schema: str) -> Column:
    """A struct from JSON with single quotes; one of nulls where it is none."""
    return F.from_json(F.coalesce(F.replace(value, F.lit("'"), F.lit('"')), F.lit("{}")), schema)


def softmax_injection(logits: Column) -> Column:
    top = F.greatest(logits[0], logits[1])
    a, b = F.exp(logits[0] - top), F.exp(logits[1] - top)
    return b / (a + b)

