"""Personal data replaced by keyed surrogates of the same type and format, in DataFrame functions only."""

from __future__ import annotations

import hashlib
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, join_groups, perhaps, staged, whole_text

#: The setting with the secret key of the registered query, and the key of examples and tests, which keeps no secret.
KEY_SETTING, EXAMPLE_KEY = "spark.catchment.pii.key", "an example, not a secret"
#: After so many attempts surrogates get longer, so that free ones never run out.
PATIENCE = 4

# The patterns of each type, titles by gender, given names by gender, syllables of surnames and letters by script.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)*\.\p{L}{2,}"
PHONE = (
    r"(?<![\p{L}\d+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?!\d)"
    r"|(?<![\p{L}\d+])\+(?:\d{7,15}|(?=(?:[ .-]?\d){7})\d{1,3}(?:[ .-]\d{1,4}){2,6})(?!\d)"
    r"|(?<![\p{L}\d+.-])(?:1-)?\d{3}-\d{3}-\d{4}(?![\d-])|(?<![\p{L}\d+.-])(?:1\.)?\d{3}\.\d{3}\.\d{4}(?!\d|\.\d)"
)
ADDRESS = r"(?<![\d.vV])(?<![Vv]ersion )\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"
ADDRESS6 = r"(?<![\p{L}\d:.])(?=[A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]{6})(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\d:])"
ACCOUNT = r"(?<![\p{L}\d])(?=(?: ?[A-Z0-9]){15})[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\d])"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
#: A card without separators also needs a valid Luhn sum; see _real.
CARD = r"(?<!\d)(?:\d{4}[ -]){3}\d{4}(?!\d)|(?<!\d)\d{4}[ -]\d{6}[ -]\d{5}(?!\d)|(?<!\d)\d{13,19}(?!\d)"
HEX = "[0-9A-Fa-f]{16,}+"
PREFIX = r"AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk-|xox[abprs]-|AIza"
SECRET = (
    rf"""(?<="){HEX}(?=")|(?<='){HEX}(?=')|(?<![\p{{L}}\d])(?:A[KS]IA[0-9A-Z]{{16}}|(?:{PREFIX})[A-Za-z0-9_-]{{16,}})(?![\p{{L}}\d])"""
    r"""|(?<=[:=] {0,2}["']?)(?:(?<=(?i:password|passwd|passphrase|pwd)["']? {0,2}[:=] {0,2}["']?)[^\s"',;<>]{6,}+"""
    r"""|(?<=(?i:secret|token|key|credential)["']? {0,2}[:=] {0,2}["']?)(?=[^\s"',;<>]*\d)[^\s"',;<>]{8,}+)"""
)
TITLES = {
    "m": "Mr Herr Monsieur Señor Sir Lord Don Mister Г-н Господин Κύριος",
    "f": "Mrs Ms Miss Frau Madame Señora Madam Señorita Mademoiselle Mme Mlle Lady Doña Г-жа Госпожа Κυρία",
    "x": "Dr Prof Professor Doctor Docteur Professeur Doctora Profesor Judge Senator President Captain Colonel General Rev",
}
NAMES = {
    "m": "Adam Boris Carl David Emil Felix Georg Henry Ivan Jonas Karim Louis Marco Nils Oscar Pablo Quentin Rafael Simon Thomas Ulrich Victor Walter Xavier",
    "f": "Alma Berta Clara Diana Elena Fiona Greta Hanna Irene Julia Karin Laura Maria Nadia Olga Paula Rosa Sara Teresa Ursula Vera Wanda Yvonne Zoe",
}
NAMES["x"] = NAMES["m"] + " " + NAMES["f"]
#: The letters of given names and syllables, and the Cyrillic and Greek ones that stand for them.
SCRIPT_LETTERS = ("abcdefghijklmnopqrstuvwxyz", {"cyrillic": "абкдефгхийклмнопкрстуввкиз", "greek": "αβκδεφγχιικλμνοπκρστυββξιζ"})
SYLLABLES = "bar ben bor dal den dor fal fen gar gel hol jan kal ken lam lor mar men mor nal nor pal ren ros sal sen tal tor val wes".split()
LATIN, ACCENTED, GREEK, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "áéíóúàèìòùâêîôûäëïöüñç", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзиклмнопрстуфхцчшэюя"

#: Titles in capitals, which count before names in capitals.
CAPITALS = {"m": "MR HERR", "f": "MRS MS MISS FRAU", "x": "DR PROF"}
#: Words of a surname that stay as they are.
PARTICLES = "von van der den dem zu zum zur de del della di da das dos do du la le las los el bin ibn al af av ter ten"

TITLE = r"(?:(?:" + "|".join(f"{TITLES[g]} {CAPITALS[g]}".replace(" ", "|") for g in "mfx") + r")\.? )+"
_TITLE_CAPITALS = r"(?:(?:" + "|".join(CAPITALS[g].replace(" ", "|") for g in "mfx") + r")\.? )+"
_PARTICLE = "(?:(?:" + PARTICLES.replace(" ", "|") + ") )"
#: A word of a name begins with a capital, or is of a script without them.
_WORD = r"(?:\p{Lu}[\p{L}'\u2019-]++|\p{Lo}{2,}+)"
_CAPITAL_WORD = r"\p{Lu}[\p{Lu}'\u2019-]++(?![\p{L}])"
#: After a title: up to three words, with initials and particles between them.
NAME = (
    rf"(?<!\p{{L}}){TITLE}(?!{TITLE}){_PARTICLE}*+{_WORD}(?: (?:\p{{Lu}}\. )*+{_PARTICLE}*+{_WORD}){{0,2}}"
    rf"|(?<!\p{{L}}){_TITLE_CAPITALS}(?!{_TITLE_CAPITALS}){_CAPITAL_WORD}(?: {_CAPITAL_WORD})?"
)
ANY = "|".join((SECRET, EMAIL, NAME, ACCOUNT, PHONE, ADDRESS, ADDRESS6, SOCIAL, CARD))


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(words: list[str]) -> str:
    return "array(" + ", ".join(map(_lit, words)) + ")"


def _kind() -> str:
    """The type of an entity, from its form."""
    title = lambda g: _lit("^(?:" + f"{TITLES[g]} {CAPITALS[g]}".replace(" ", "|") + r")\.? ")
    whole = lambda pattern: f"entity RLIKE {_lit('^(?:' + pattern + ')$')}"
    named = " ".join(f"WHEN entity RLIKE {title(g)} THEN 'name_{g}'" for g in "mfx")
    forms = (("email", EMAIL), ("iban", ACCOUNT), ("address", ADDRESS), ("ipv6", ADDRESS6), ("social", SOCIAL), ("card", CARD), ("phone", PHONE), ("secret", HEX))
    return f"CASE {named} {' '.join(f"WHEN {whole(p)} THEN '{k}'" for k, p in forms)} ELSE 'key' END"


def _canonical() -> str:
    """What two spellings of one entity share: digits without separators (a phone's country code and the rest), lower case; keys as they are."""
    cut = "regexp_extract(entity, '^[+]([0-9]{1,3})(?=[ .(-])', 1)"
    run = "regexp_extract(entity, '^[+](1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})', 1)"
    code = f"coalesce(nullif({cut}, ''), {run})"
    return f"""CASE WHEN kind = 'phone' THEN concat({code}, ':', substring(regexp_replace(entity, '[^0-9]', ''), length({code}) + 1))
      WHEN kind IN ('card', 'social') THEN regexp_replace(entity, '[^0-9]', '') WHEN kind = 'iban' THEN replace(entity, ' ', '') WHEN kind = 'key' THEN entity
      WHEN kind LIKE 'name%' THEN lower(regexp_replace(entity, {_lit("^" + TITLE)}, '')) ELSE lower(entity) END"""


def _pads(key: str) -> tuple[str, str]:
    """The inner and outer key blocks of HMAC-SHA256, as SQL binary literals."""
    block = key.encode()
    block = (hashlib.sha256(block).digest() if len(block) > 64 else block).ljust(64, b"\0")
    return tuple("X'" + bytes(b ^ x for b in block).hex() + "'" for x in (0x36, 0x5C))


def _seed(key: str, *named: str) -> str:
    """HMAC-SHA256 of what is named, as 64 hexadecimal digits."""
    inner, outer = _pads(key)
    return f"sha2(concat({outer}, unhex(sha2(concat({inner}, cast(concat_ws('|', {', '.join(named)}) AS binary)), 256))), 256)"


def _stream(what: str, seed: str = "seed") -> str:
    """64 hexadecimal digits that depend on a seed and on a part of what is named."""
    return f"sha2(concat_ws('|', {seed}, {what}), 256)"


def _number(stream: str, at: str) -> str:
    """A number below 65536 from place `at` (0, 1, ...) of a stream."""
    return f"cast(conv(substring({stream}, ({at}) % 61 + 1, 4), 16, 10) AS int)"


def _char(alphabet: str, stream: str, at: str) -> str:
    return f"substring({_lit(alphabet)}, {_number(stream, at)} % {len(alphabet)} + 1, 1)"


def _letters(text: str, stream: str) -> str:
    """text with each letter and digit replaced by one of its script and case; everything else stays."""
    kinds = (("[0-9]", "0123456789"), ("[a-z]", LATIN), ("[A-Z]", LATIN.upper()), (r"\\p{IsGreek}", GREEK), (r"\\p{IsCyrillic}", CYRILLIC), (r"\\p{Ll}", ACCENTED), (r"\\p{Lu}", ACCENTED.upper()))
    cases = " ".join(f"WHEN c RLIKE '^{p}$' THEN {_char(a, stream, 'i')}" for p, a in kinds)
    return f"array_join(transform(split({text}, ''), (c, i) -> CASE {cases} ELSE c END), '')"


def _luhn(digits: str) -> str:
    """The Luhn sum of a string of digits."""
    return f"aggregate(transform(split(reverse({digits}), ''), (c, i) -> CASE WHEN i % 2 = 0 THEN cast(c AS int) ELSE cast(c AS int) * 2 - IF(cast(c AS int) > 4, 9, 0) END), 0, (a, x) -> a + x)"


def _digits() -> str:
    """As many new digits as canonical has after a phone's country code, which stays, and surplus ones; a valid Luhn sum stays valid."""
    plain = f"array_join(transform(sequence(1, length(substring_index(canonical, ':', -1)) + surplus), i -> cast({_number(_stream('concat(canonical, i div 61)'), 'i')} % 10 AS string)), '')"
    body = f"left({plain}, length(canonical) + surplus - 1)"
    check = f"cast((10 - {_luhn(f'concat({body}, {_lit("0")})')} % 10) % 10 AS string)"
    return f"CASE WHEN kind = 'phone' THEN concat(substring_index(canonical, ':', 1), ':', {plain}) WHEN kind = 'card' AND {_luhn('canonical')} % 10 = 0 THEN concat({body}, {check}) ELSE {plain} END"


def _account() -> str:
    """An account number of the same country and form with valid check digits."""
    body = _letters("concat(substring(canonical, 5), repeat('0', surplus))", _stream("canonical"))
    rest = f"aggregate(split(concat({body}, left(canonical, 2), '00'), ''), 0, (a, c) -> CASE WHEN c = '' THEN a WHEN c RLIKE '[0-9]' THEN (a * 10 + cast(c AS int)) % 97 ELSE (a * 100 + ascii(c) - 55) % 97 END)"
    return f"concat(left(canonical, 2), lpad(cast(98 - {rest} AS string), 2, '0'), {body})"


def _tokens() -> str:
    """(place, token, role) of a name's words: particle, initial, given or surname (the last of the others)."""
    plain = f"array_except(split(canonical, ' '), {_array(PARTICLES.split())})"
    last = "array_max(filter(transform(split(canonical, ' '), (x, j) -> IF(NOT x RLIKE '^\\\\p{L}[.]$' AND NOT array_contains(PARTS, x), j, null)), j -> j IS NOT NULL))".replace("PARTS", _array(PARTICLES.split()))
    role = f"CASE WHEN t RLIKE '^\\\\p{{L}}[.]$' THEN 'initial' WHEN NOT array_contains({plain}, t) THEN 'particle' WHEN i = {last} THEN 'surname' ELSE 'given' END"
    return f"transform(split(canonical, ' '), (t, i) -> struct(i AS place, t AS token, {role} AS role))"


def _turned(key: str) -> str:
    """An initial's other letter: its alphabet turned by a number of places that the key decides, so that no two initials meet."""
    digest = int.from_bytes(hashlib.sha256(b"initials|" + key.encode()).digest()[:4], "big")
    turn = lambda letters: letters[(k := 1 + digest % (len(letters) - 1)) :] + letters[:k]
    alphabets = (LATIN, GREEK, CYRILLIC, ACCENTED)
    return f"translate(upper(token), {_lit(''.join(a.upper() for a in alphabets))}, {_lit(''.join(turn(a).upper() for a in alphabets))})"


def _real() -> str:
    """Whether a match is an entity: runs of 13 to 19 digits only with a valid Luhn sum."""
    return f"NOT (entity RLIKE '^[0-9]{{13,19}}$') OR {_luhn('entity')} % 10 = 0"


def _in_script(word: str) -> str:
    """A Latin word in the script of canonical: its letters are replaced one by one."""
    latin, others = SCRIPT_LETTERS
    both = lambda letters: f"translate({word}, {_lit(latin + latin.upper())}, {_lit(letters + letters.upper())})"
    return f"CASE WHEN canonical RLIKE '[\\\\p{{IsCyrillic}}]' THEN {both(others['cyrillic'])} WHEN canonical RLIKE '[\\\\p{{IsGreek}}]' THEN {both(others['greek'])} ELSE {word} END"


def _replacement() -> str:
    """The surrogate of (kind, canonical, attempt, surplus, seed), before it takes an entity's format. Names come word by word."""
    part = lambda i: f"element_at({_array(SYLLABLES)}, {_number('seed', str(i))} % {len(SYLLABLES)} + 1)"
    more = f"array_join(transform(sequence(1, surplus), i -> element_at({_array(SYLLABLES)}, {_number(_stream('i'), '0')} % {len(SYLLABLES)} + 1)), '')"
    longer = f"IF(surplus > 0, {more}, '')"
    given = lambda g: f"concat(element_at({_array(NAMES[g].split())}, {_number('seed', '0')} % {len(NAMES[g].split())} + 1), IF(attempt > 0, {part(8)}, ''), {longer})"
    surname = f"initcap(concat({part(8)}, {part(16)}, {part(24)}, IF(attempt > 2, {part(32)}, ''), {longer}))"
    wide = f"cast({_number(_stream('canonical'), '7 * i')} % 256 AS string)"
    octet = f"""CASE WHEN surplus > 0 THEN {wide} WHEN length(o) = 1 THEN cast({_number(_stream('canonical'), '7 * i')} % 10 AS string) WHEN length(o) = 2 THEN cast(10 + {_number(_stream('canonical'), '7 * i')} % 90 AS string) ELSE cast(100 + {_number(_stream('canonical'), '7 * i')} % 156 AS string) END"""
    domain = "substring_index(canonical, '@', -1)"
    local = "substring_index(canonical, '@', 1)"
    prefix = f"regexp_extract(canonical, {_lit('^(' + PREFIX + ')')}, 1)"
    labels = f"regexp_replace({domain}, '[.][^.]*$', '')"
    letters = lambda text: _letters(f"concat({text}, repeat('a', surplus))", _stream("canonical"))
    hexes = f"""array_join(transform(split(concat(canonical, IF(kind = 'secret', repeat('a', surplus), '')), ''), (c, i) -> CASE WHEN c = ':' THEN c WHEN c RLIKE '[0-9]' THEN {_char("0123456789", _stream("canonical"), "i + 7 * (i div 61)")} ELSE {_char("abcdef", _stream("canonical"), "i + 7 * (i div 61)")} END), '')"""
    return f"""CASE WHEN kind IN ('phone', 'card', 'social') THEN {_digits()}
      WHEN kind = 'address' THEN array_join(transform(split(canonical, '[.]'), (o, i) -> {octet}), '.')
      WHEN kind = 'email' THEN concat({letters(local)}, '@', {_letters(labels, "domain_seed")}, '.', substring_index({domain}, '.', -1))
      WHEN kind = 'iban' THEN {_account()}
      WHEN kind = 'key' THEN concat({prefix}, {letters(f"substring(canonical, length({prefix}) + 1)")})
      WHEN kind IN ('secret', 'ipv6') THEN {hexes}
      WHEN kind = 'given_m' THEN {_in_script(given("m"))} WHEN kind = 'given_f' THEN {_in_script(given("f"))} WHEN kind = 'given_x' THEN {_in_script(given("x"))}
      ELSE {_in_script(surname)} END"""


def _formatted() -> str:
    """The surrogate in the format of the entity: separators, country code, title and case."""
    rank = "length(regexp_replace(left(entity, i + 1), '[^0-9]', ''))"
    spaced = "array_join(transform(split(entity, ''), (c, i) -> IF(c = ' ', c, substring(surrogate, length(replace(left(entity, i + 1), ' ', '')), 1))), '')"
    held = "length(regexp_replace(entity, '[^0-9]', ''))"
    digits = f"concat(array_join(transform(split(entity, ''), (c, i) -> IF(c RLIKE '[0-9]', substring(replace(surrogate, ':', ''), {rank}, 1), c)), ''), substring(replace(surrogate, ':', ''), {held} + 1))"
    return f"""CASE WHEN kind IN ('phone', 'card', 'social') THEN {digits}
      WHEN kind = 'iban' THEN concat({spaced}, substring(surrogate, length(replace(entity, ' ', '')) + 1)) WHEN kind = 'key' THEN surrogate
      WHEN kind LIKE 'name%' THEN concat(regexp_extract(entity, {_lit("^" + TITLE)}, 0), IF(entity RLIKE {_lit("^" + _TITLE_CAPITALS)} AND entity = upper(entity), upper(surrogate), surrogate))
      WHEN entity = upper(entity) AND entity <> lower(entity) THEN upper(surrogate) ELSE surrogate END"""


def _entities() -> Column:
    return F.regexp_extract_all("text", F.lit(ANY), F.lit(0))


def _has_entities() -> Column:
    """Whether text may have an entity. All but names have a digit, an @, a quote or a password's label, which is quick to see; few texts need the whole pattern."""
    text = F.col("text")
    return (text.rlike("[0-9@\"]|'[A-Fa-f]{16}|[:=] {0,2}'?(?<=(?i:password|passwd|passphrase|pwd)'? {0,2}[:=] {0,2}'?)") | text.rlike(PREFIX) | text.rlike(NAME)) & text.rlike(ANY)


def _mentions() -> str:
    """(mention, surrogate) for each titled name of map: the name without its title and each of its words, the longest first, once each."""
    bare = lambda x: f"regexp_replace({x}, {_lit('^' + TITLE)}, '')"
    names = f"transform(filter(map_entries(map), e -> e.key RLIKE {_lit('^' + TITLE)}), e -> struct({bare('e.key')} AS k, {bare('e.value')} AS v))"
    words = "concat(array(e), IF(size(split(e.k, ' ')) > 1 AND size(split(e.k, ' ')) = size(split(e.v, ' ')), filter(transform(split(e.k, ' '), (x, i) -> struct(x AS k, split(e.v, ' ')[i] AS v)), x -> x.k <> x.v), array()))"
    return f"array_sort(filter(flatten(transform({names}, e -> {words})), e -> length(e.k) > 2), (x, y) -> CASE WHEN length(x.k) <> length(y.k) THEN length(y.k) - length(x.k) WHEN x < y THEN -1 WHEN x > y THEN 1 ELSE 0 END)"


def _with_mentions(cut: DataFrame) -> DataFrame:
    """cut(map, between, ...) with the bare mentions of its titled names replaced in between, all in one pass."""
    pattern = r"concat('(?<![\\p{L}\\p{N}])(?:', array_join(transform(mentions, e -> e.k), '|'), ')(?![\\p{L}\\p{N}])')"
    value = "filter(mentions, e -> e.k = get(regexp_extract_all(x, pattern, 0), i))"
    woven = f"transform(between, x -> array_join(transform(split(x, pattern, -1), (y, i) -> concat(y, coalesce(get({value}, 0).v, ''))), ''))"
    named = cut.withColumn("mentions", F.expr(_mentions())).withColumn("pattern", F.expr(f"IF(size(mentions) > 0, {pattern}, null)"))
    return named.withColumn("between", F.expr(f"IF(pattern IS NULL, between, {woven})")).drop("mentions", "pattern")


def surrogates(found: DataFrame, key: str = EXAMPLE_KEY, patience: int = PATIENCE) -> DataFrame:
    """(entity, replacement, n) for found(entity, n) with one row per spelling.

    Spellings of one entity share a canonical form, which the keyed hash (HMAC-SHA256) maps to a surrogate, so
    an entity gets the same one everywhere. A name is mapped word by word, given names and surnames for themselves, so a
    surname has one surrogate whatever stands before it, and a given name one whatever its title; initials turn to others, particles stay. Surrogates of one kind that meet, or that are themselves
    entities of the corpus, are tried again with the next attempt number until all differ; the smallest of those that
    meet keeps its own. From the attempt `patience` on, each is one letter, digit or syllable longer than the one
    before (addresses: any octets), so the loop ends whatever share of a format the corpus uses up.
    """
    named = staged(found.withColumn("kind", F.expr(_kind())).withColumn("canonical", F.expr(_canonical())), "entities")
    tokens = staged(named.filter("kind LIKE 'name%'").select("entity", "kind", F.expr(f"inline({_tokens()})")), "tokens")
    # A given name is of one gender wherever it stands: that of its titles, if they agree.
    shown = F.when(F.col("kind") != "name_x", F.right("kind", F.lit(1)))
    gender = staged(tokens.filter("role = 'given'").groupBy("token").agg(F.min(shown).alias("low"), F.max(shown).alias("high")).select("token", F.expr("IF(low = high, low, 'x')").alias("gender")), "genders")
    gender = gender.select("token", F.lit("given").alias("role"), F.concat(F.lit("given_"), F.coalesce("gender", F.lit("x"))).alias("unit"))
    tokens = staged(tokens.join(gender, ["token", "role"], "left").withColumn("unit", F.coalesce("unit", "role")).drop("role"), "roles")
    words = tokens.filter("unit LIKE 'given%' OR unit = 'surname'").select(F.col("unit").alias("kind"), F.col("token").alias("canonical"))
    units = staged(named.filter("NOT kind LIKE 'name%'").select("kind", "canonical").unionByName(words).distinct(), "units")
    open_, real = units, units.select("kind", F.lower("canonical").alias("seen")).distinct()
    done, attempt = None, 0
    while True:
        tried = open_.withColumn("attempt", F.lit(attempt)).withColumn("surplus", F.lit(max(0, attempt - patience)))
        tried = tried.withColumns({"seed": F.expr(_seed(key, "kind", "attempt", "canonical")), "domain_seed": F.expr(_seed(key, "'domain'", "substring_index(canonical, '@', -1)"))})
        tried = staged(tried.select("kind", "canonical", F.expr(_replacement()).alias("surrogate")).withColumn("seen", F.lower("surrogate")), "tried")
        taken = real if done is None else real.unionByName(done.select("kind", "seen"))
        free = tried.join(taken, ["kind", "seen"], "left_anti")
        first = free.groupBy("kind", "seen").agg(F.min("canonical").alias("canonical"))
        won = staged(tried.join(first, ["kind", "seen", "canonical"], "left_semi"), "won")
        done = won if done is None else staged(done.unionByName(won), "done")
        open_ = tried.select("kind", "canonical").join(won.select("kind", "canonical"), ["kind", "canonical"], "left_anti")
        if open_.isEmpty():
            break
        attempt += 1
    solved = done.select("kind", "canonical", "surrogate")
    plain = named.filter("NOT kind LIKE 'name%'").join(solved, ["kind", "canonical"])
    each = tokens.join(solved.select(F.col("kind").alias("unit"), F.col("canonical").alias("token"), "surrogate"), ["unit", "token"], "left")
    each = each.withColumn("word", F.expr(f"CASE WHEN unit = 'initial' THEN {_turned(key)} ELSE coalesce(surrogate, token) END"))
    whole = each.groupBy("entity").agg(F.expr("array_join(transform(array_sort(collect_list(struct(place, word))), x -> x.word), ' ')").alias("surrogate"))
    people = named.filter("kind LIKE 'name%'").join(whole, "entity")
    both = plain.select("entity", "kind", "canonical", "surrogate", "n").unionByName(people.select("entity", "kind", "canonical", "surrogate", "n"))
    return both.select("entity", F.expr(_formatted()).alias("replacement"), "n")


def secret_key(spark: SparkSession) -> str:
    """The session's key. Without one the example key, with a warning: surrogates made with it keep no secret."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: surrogates are made with the published example key and keep no secret", stacklevel=2)
    return key or EXAMPLE_KEY


def replace_entities(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs(doc_id, text, ...) with every entity in text replaced, n_chars (if there) recounted, and n_entities added (replacing any such column).

    key is the secret of the surrogates (the session's, if None; see secret_key): the same key gives the same ones. Null texts stay null with no entities, empty ones empty;
    other columns pass through; no rows give no rows. Bare mentions of a titled name in the same text are replaced with it, but not
    counted. Texts are searched once; rows without entities, told apart by a filter over doc_id and text hash, pass straight, the
    others meet their distinct entities' surrogates (a frequent one by broadcast, see join_groups); so repeated rows are treated alike.
    A text of any length is one value of a row, searched as a whole.
    """
    key = secret_key(docs.sparkSession) if key is None else key
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_chars", "n_entities")]
    packed = docs.select(F.struct(*columns).alias("doc"), "text").withColumn("row", F.xxhash64("doc.doc_id", "text"))
    found = packed.filter(_has_entities()).select("row", F.explode(F.array_distinct(_entities())).alias("entity")).filter(_real())
    found = staged(found.distinct(), "found")
    total = found.count()
    table = staged(surrogates(found.groupBy("entity").agg(F.count("*").alias("n")), key), "surrogates")
    pairs = join_groups(found, table, "entity", "n", total)
    maps = staged(pairs.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("entity", "replacement"))).alias("map")), "maps")
    tested = perhaps(packed, maps, "row")
    clean = tested.filter("NOT __maybe OR text IS NULL").select("doc", "text", F.lit(0).cast("long").alias("n_entities"))
    cut = tested.filter("__maybe AND text IS NOT NULL").drop("__maybe").join(maps, "row", "left").withColumn("map", F.coalesce("map", F.expr("cast(map() AS map<string, string>)")))
    cut = _with_mentions(cut.withColumn("found", _entities()).withColumn("between", F.split("text", ANY, -1)))
    woven = F.expr("array_join(transform(between, (x, i) -> concat(x, coalesce(try_element_at(map, get(found, i)), get(found, i), ''))), '')")
    changed = cut.select("doc", woven.alias("text"), F.expr("size(filter(found, e -> map_contains_key(map, e)))").cast("long").alias("n_entities"))
    both = clean.unionByName(changed)
    out = {c: F.col(f"doc.`{c}`") for c in docs.columns if c not in ("text", "n_chars", "n_entities")}
    out |= {"text": F.col("text"), "n_chars": F.length("text").cast("long"), "n_entities": F.col("n_entities")}
    names = [c for c in docs.columns if c != "n_entities"] + ["n_entities"]
    return both.select(*[out[c].alias(c) for c in names])


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = replace_entities(documents(spark, sf_dir))
    return done.select("doc_id", "n_entities", "text", F.sha2(whole_text().cast("binary"), 256).alias("text_sha256"))
