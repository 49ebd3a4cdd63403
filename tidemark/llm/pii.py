"""PII: surrogate generation, in DataFrame and SQL functions only.

Entities are found by pattern: e-mail addresses, credentials, IBANs, phone
numbers, IPv4 addresses, social security numbers, card numbers, and persons (a
title or a known given name before a capitalised one; the README says which
telephone numbers and persons are not found). Each entity gets a
surrogate drawn from a keyed hash of its kind and normal form: the same entity
has the same surrogate everywhere (coreference), spelled like each occurrence
(letter case, separators). Kinds stay consistent: digits for digits, letters
for letters, valid octets and private ranges for addresses, valid check digits
where the original had one, names of the same gender and script; a surname is
the same after a title as after a given name. Distinct entities never share a
surrogate, and no surrogate is itself an entity of the corpus: collisions are
searched over all entities, and the losers are drawn again until none is left.
From attempt ``WIDER`` on each attempt draws from a larger space (a longer name,
number or local part, another private range, at last IPv6), so that a shape
whose values are all taken ends too. A blank after a keyword ("Password:
________") holds no letter or digit and is no entity.

Plan: a narrow pass finds the documents that may hold entities by a few marks,
searches those for all kinds, and writes them alone;
the distinct entities are aggregated (a hot one folds before the shuffle) and
their surrogates checked by grouping; occurrences join the surrogates on a
salted key, so that an entity in a third of all documents spreads over tasks;
documents without entities are never shuffled. Nothing reaches the driver but
the count of collisions.

Edge cases: a null text stays null, an empty one empty, both with 0 entities;
repeated rows are replaced alike, one by one; null ids stay; long texts are
scanned whole; an empty table stays empty; all other columns are carried
unchanged whatever their names (the input is held in one struct meanwhile).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

#: salts of the join of occurrences with surrogates
SALTS = 8
#: the first attempt at a surrogate that may be longer than its entity
WIDER = 3

# Titles by gender, given names and syllables by script.
TITLES = {"m": ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин"), "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Señora", "Sra", "Госпожа"),
          "n": ("Dr", "Prof")}
GIVEN = {
    ("m", "latin"): tuple("""James John Robert Michael William David Thomas Daniel Paul Peter Hans Karl Pierre Jean José Carlos
        Richard Joseph Charles Christopher Matthew Anthony Steven Andrew Kenneth Joshua Kevin Brian George Edward Ronald Timothy Jason Jeffrey Ryan Jacob
        Gary Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel Gregory Alexander Patrick Dennis Jerry Tyler Aaron Adam Nathan Henry
        Douglas Zachary Kyle Noah Ethan Jeremy Keith Roger Terry Sean Gerald Carl Harold Arthur Lawrence Dylan Jesse Bryan Billy Bruce Gabriel Joe Logan Alan
        Ralph Roy Eugene Randy Vincent Russell Louis Philip Bobby Johnny Oliver Harry Jack Simon Martin Ian Graham Colin Neil Stuart Liam Owen
        Fritz Klaus Jürgen Wolfgang Dieter Manfred Uwe Günter Horst Bernd Werner Heinz Helmut Gerhard Stefan Andreas Matthias Markus Sebastian Florian Tobias
        Jens Sven Lars Lukas Jonas Felix Moritz Niklas Tim Jan Ralf Rainer Heinrich Friedrich Ludwig Otto Johannes Holger Thorsten Dirk Frank
        Michel André Philippe Jacques François Alain Bernard Patrice Christophe Nicolas Julien Laurent Frédéric Stéphane Olivier Éric Pascal Thierry Gilles
        Antoine Guillaume Mathieu Luc Marc Henri Gérard René Claude Émile Étienne Jérôme Rémi Sébastien Hugo Théo Yves Didier Xavier Benoît Cédric Fabien
        Antonio Manuel Francisco Juan Javier Jesús Miguel Rafael Pedro Ángel Alejandro Fernando Luis Pablo Sergio Jorge Alberto Álvaro Diego Adrián Raúl
        Enrique Ramón Vicente Andrés Joaquín Eduardo Roberto Iván Rubén Óscar Jaime Ignacio Mario Salvador Marcos Gonzalo Felipe Tomás Emilio""".split()),
    ("f", "latin"): tuple("""Mary Patricia Jennifer Linda Elizabeth Barbara Susan Sarah Anna Laura Greta Heidi Marie Claire María Carmen
        Jessica Karen Lisa Nancy Betty Sandra Margaret Ashley Kimberly Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Sharon Cynthia
        Kathleen Amy Angela Shirley Emma Brenda Pamela Nicole Samantha Katherine Christine Helen Debra Rachel Carolyn Janet Catherine Maria Heather Diane
        Olivia Julie Joyce Victoria Ruth Lauren Kelly Christina Joan Evelyn Judith Andrea Hannah Megan Cheryl Jacqueline Martha Madison Teresa Gloria Sara
        Janice Ann Kathryn Abigail Sophia Frances Jean Alice Judy Isabella Julia Denise Amber Doris Marilyn Danielle Beverly Charlotte Natalie Theresa Diana
        Lucy Jane Chloe Fiona Eleanor Harriet Lily Zoe Molly Kate Annie Ellen Anne Sophie
        Ursula Petra Monika Renate Ingrid Sabine Birgit Gisela Helga Brigitte Claudia Susanne Karin Angelika Katharina Anja Silke Heike Kerstin Martina
        Ute Lena Leonie Mia Johanna Franziska Jana Nadine Tanja Elke Gabriele Hildegard Erika Christa Anneliese Käthe Bärbel Lieselotte Frieda
        Nathalie Isabelle Sylvie Catherine Martine Françoise Monique Jacqueline Valérie Céline Camille Léa Manon Chantal Véronique Hélène Élodie Aurélie
        Amélie Juliette Élise Émilie Geneviève Margaux Inès Agnès Brigitte Corinne Dominique Florence Pauline Mathilde Lucie Océane Noémie Delphine
        Josefa Isabel Ana Dolores Pilar Teresa Francisca Cristina Lucía Marta Elena Antonia Mercedes Rosario Raquel Paula Beatriz Silvia Irene
        Concepción Montserrat Rocío Inés Ángela Sofía Nuria Alba Yolanda Esther Marina Lorena Margarita Verónica Alicia Susana Consuelo Inmaculada""".split()),
    ("m", "cyrillic"): tuple("""Иван Пётр Сергей Алексей Дмитрий Николай Павел Андрей Александр Михаил Владимир Юрий Виктор Евгений Борис Олег
        Игорь Константин Василий Григорий Максим Артём Антон Роман Денис Кирилл Никита Илья Фёдор Степан""".split()),
    ("f", "cyrillic"): tuple("""Анна Мария Ольга Елена Наталья Ирина Татьяна Светлана Екатерина Людмила Галина Марина Юлия Анастасия Дарья
        Валентина Нина Ксения Полина Александра Виктория Алина Софья Лариса Тамара Оксана""".split()),
}
# a name is drawn and read under one gender, the first that lists it, and once
GIVEN = {k: tuple(n for i, n in enumerate(v) if n not in v[:i] and not (k[0] == "f" and n in GIVEN["m", k[1]])) for k, v in GIVEN.items()}
SYLLABLES = {"latin": ("ba", "den", "fi", "gor", "hal", "jo", "ken", "lor", "min", "nar", "pel", "rud", "sen", "tor", "val", "wes"),
             "cyrillic": ("ба", "ден", "фи", "гор", "ха", "йо", "кен", "лор", "мин", "нар", "пел", "руд", "сен", "тор", "вал", "зес")}



def _script(c: str) -> str:
    return "ascii" if c < "\x80" else "cyrillic" if c >= "\u0400" else "other"


def _any_of(words: set[str]) -> str:
    """A pattern of the words that shares their beginnings, so that a long list costs a few comparisons a place."""
    heads: dict[str, set[str]] = {}
    for w in words - {""}:
        heads.setdefault(w[0], set()).add(w[1:])
    some = "|".join(h + _any_of(tails) for h, tails in sorted(heads.items()))
    return f"(?:{some})" + ("?" if "" in words else "") if some else ""


_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_NAMES = _any_of({n for ns in GIVEN.values() for n in ns})
_CAPITALS = "".join(sorted({n[0] for ns in (*TITLES.values(), *GIVEN.values()) for n in ns}))
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_NAME = r"\p{Lu}[\p{L}'-]*\p{L}"
# telephone numbers: after + or 00 the lengths of the corpus' countries, else 8 to 15 digits; groups of a national number after its 0
_SEP, _TRUNK = r"[ \u00a0./-]?", r"(?:[ \u00a0]?\(0\))?"
_ABROAD = (rf"(?<![\p{{L}}\p{{N}}+])(?:\+|(?<!\p{{N}}[.,:/-])00(?=[1-9][0-9]{{0,2}}[ \u00a0.-]))(?:3[34]{_TRUNK}(?:{_SEP}[0-9]){{9}}|1(?:{_SEP}[0-9]){{10}}"
           rf"|44{_TRUNK}(?:{_SEP}[0-9]){{9,10}}|[1-9][0-9]{{0,2}}[ \u00a0]?\([0-9]{{1,5}}\)(?:{_SEP}[0-9]){{5,10}}|[1-9](?:{_SEP}[0-9]){{7,14}})(?!\p{{N}})")
_HOME = (r"(?<![\p{L}\p{N}+])(?<!\p{N}[.,:/-])(?<!\p{L}-)(?![0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}(?![\p{L}\p{N}]))"
         r"(?:0[1-9](?:(?:[ \u00a0][0-9]{2}){4}|(?:\.[0-9]{2}){4}|(?:-[0-9]{2}){4})|[6-9][0-9]{2}(?:[ \u00a0][0-9]{2}){3}"
         r"|(?:0[1-9][0-9]{1,3}|\(0[1-9][0-9]{1,3}\))(?: ?[/-] ?|[ \u00a0])"
         r"(?:[0-9]{5,9}|[0-9]{3}[ -][0-9]{3}[ -][0-9]{2,4}|[0-9]{3,4}[ -][0-9]{3,5}|[0-9]{2,3}(?:[ -][0-9]{2}){2,3}))(?!\p{N})")

#: kind -> pattern; an earlier kind wins where several begin. Each begins with a cheap test of one character.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?=[0-9a-fA-F])" + _BEFORE + r"[0-9a-fA-F]{32,}+" + _AFTER
    + r"""|(?<=[=: "])(?<=(?i:token|secret|password|passwd|api_key|apikey) {0,2}[=:] {0,2}"?)(?=[_/+-]*+[A-Za-z0-9])[A-Za-z0-9_/+-]{8,}""",
    "iban": r"(?=[A-Z])" + _BEFORE + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?" + _AFTER,
    "phone": r"(?=[0-9+(])(?:(?:(?<![\p{L}\p{N}+])\+?[0-9]{1,3}[ .-]?)?(?<!\p{N})\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?!\p{N})"
    + rf"|{_ABROAD}" + r"|(?<![\p{L}\p{N}+])(?:\+?[0-9]{1,3}[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?!\p{N})|(?<![\p{L}\p{N}+])\+[0-9]{8,15}(?!\p{N})" + rf"|{_HOME})",
    "ip": r"(?=[0-9])(?<![\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?\p{N})",
    "ssn": r"(?=[0-9])(?<![\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{N}-])",
    "card": r"(?=[0-9])(?<![\p{L}\p{N}])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{13,19})(?![\p{L}\p{N}])",
    "person": rf"(?=[{_CAPITALS}])" + _BEFORE + rf"(?:(?:{_TITLE})\.? (?:{_NAME} )?{_NAME}|{_NAMES} {_NAME})" + _AFTER,
}
_STARTS = {n for ns in (*TITLES.values(), *GIVEN.values()) for n in ns}
_PERSON_MARK = "|".join(rf"(?=[{capitals}]){_any_of({n for n in _STARTS if _script(n[0]) == g})}\.? \p{{Lu}}"
                        for g, capitals in (("ascii", "A-Z"), ("cyrillic", "А-Я"), ("other", "À-Þ")))
#: any text with an entity holds one of these; cheap to look for, so that most texts are not searched for all kinds
MARKS = rf"[0-9@:=]|{_PERSON_MARK}|[a-fA-F]{{32}}"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _kind(match: str) -> str:
    """SQL: which pattern the match is of. Look-arounds see only the match, so it must fit from end to end."""
    strict = {"secret": r"[0-9a-fA-F]{32,}"}
    cases = " ".join(f"when {match} rlike {_lit('^(?:' + strict.get(k, p) + ')$')} then '{k}'" for k, p in PATTERNS.items())
    return f"case {cases} else 'secret' end"


def _array(values: tuple[str, ...]) -> str:
    return "array(" + ", ".join(map(_lit, values)) + ")"


def _parts(match: str, kind: str) -> str:
    """SQL: the match as an array of (kind, norm, shown); kind null: kept as it is. A person is taken apart into
    title, given name and surname."""
    digits = f"regexp_replace(replace({match}, '(0)', ''), '[^0-9]', '')"
    phone = (f"case when {match} like '+%' then concat('+', {digits}) when {digits} like '00%' then concat('+', substr({digits}, 3)) "
             f"when length({digits}) > 10 and {digits} not like '0%' then concat('+', {digits}) else {digits} end")
    norm = (f"case when {kind} = 'phone' then {phone} when {kind} in ('ssn', 'card') then regexp_replace({match}, '[^0-9]', '') "
            f"when {kind} = 'iban' then upper(replace({match}, ' ', '')) when {kind} in ('email', 'secret') then lower({match}) else {match} end")
    female, male = (_array(TITLES[g]) for g in ("f", "m"))
    given = {g: _array(tuple(n for (h, _), ns in GIVEN.items() if h == g for n in ns)) for g in "mf"}
    gender = (f"case when array_contains({female}, rtrim('.', w[0])) or array_contains({given['f']}, w[0]) or (size(w) = 3 and array_contains({given['f']}, w[1])) then 'f' "
              f"when array_contains({male}, rtrim('.', w[0])) or array_contains({given['m']}, w[0]) or (size(w) = 3 and array_contains({given['m']}, w[1])) then 'm' else 'n' end")
    titled = f"array_contains({_array(tuple(t for ts in TITLES.values() for t in ts))}, rtrim('.', w[0]))"
    script = "case when x rlike '\\\\p{IsCyrillic}' then 'cyrillic' else 'latin' end"
    role = f"case when i = size(w) - 1 then 'surname' else 'given_' || {gender} end || '_' || {script}"
    person = (f"flatten(transform(array(split({match}, ' ')), w -> transform(w, (x, i) -> "
              f"case when i = 0 and {titled} then named_struct('kind', cast(null as string), 'norm', cast(null as string), 'shown', x) "
              f"else named_struct('kind', {role}, 'norm', lower(x), 'shown', x) end)))")
    return f"case when {kind} = 'person' then {person} else array(named_struct('kind', {kind}, 'norm', {norm}, 'shown', {match})) end"


def _digits_in(digits: str, shown: str) -> str:
    """SQL: ``shown`` with its digits replaced, in order, by ``digits``; digits left over follow."""
    return (f"concat(array_join(transform(split({shown}, ''), (c, i) -> case when c between '0' and '9' "
            f"then substr({digits}, length(regexp_replace(substr({shown}, 1, i + 1), '[^0-9]', '')), 1) else c end), ''), "
            f"substr({digits}, length(regexp_replace({shown}, '[^0-9]', '')) + 1))")


def _shown(kind: str, new: str, shown: str) -> str:
    """SQL: the surrogate as the occurrence spells it."""
    phone = f"concat(case when {new} like '+%' and {shown} like '00%' then '00' else '' end, replace({new}, '+', ''))"
    return f"""case when {kind} is null then {shown}
        when {kind} = 'phone' then replace({_digits_in(phone, f"replace({shown}, '(0)', '(°)')")}, '(°)', '(0)')
        when {kind} in ('ssn', 'card') then {_digits_in(new, shown)}
        when {kind} = 'iban' then concat(array_join(transform(split({shown}, ''), (c, i) -> case when c = ' ' then c
            else substr({new}, length(replace(substr({shown}, 1, i + 1), ' ', '')), 1) end), ''), substr({new}, length(replace({shown}, ' ', '')) + 1))
        when {shown} = upper({shown}) and {shown} != lower({shown}) then upper({new})
        when {kind} in ('email', 'secret') then concat(array_join(transform(split({shown}, ''), (c, i) -> case when c != lower(c)
            then upper(substr({new}, i + 1, 1)) else substr({new}, i + 1, 1) end), ''), substr({new}, length({shown}) + 1))
        when {kind} like 'given%' or {kind} like 'surname%' then initcap({new}) else {new} end"""


def _luhn(digits: str) -> str:
    """SQL: sum of the digits, every second one from the last doubled, digit sums of two-digit results."""
    return (f"aggregate(transform(split(reverse({digits}), ''), (c, i) -> case when i % 2 = 0 then cast(c as int) "
            f"else cast((2 * cast(c as int)) div 10 + (2 * cast(c as int)) % 10 as int) end), 0, (a, x) -> a + x)")


#: SQL: byte number i of the keyed stream
_AT = "cast(conv(substr(stream, (2 * ({})) % 256 + 1, 2), 16, 10) as int)"


def _syllables(n: str) -> str:
    pick = lambda s: f"get({_array(SYLLABLES[s])}, {_AT.format('i + 8')} % 16)"
    return (f"array_join(transform(sequence(1, {n}), i -> case when kind like '%cyrillic' then {pick('cyrillic')} "
            f"else {pick('latin')} end), '')")


def draw(rows: DataFrame, key: str) -> DataFrame:
    """(kind, norm, attempt) with ``new``, the surrogate in normal form."""
    seed = F.concat_ws("|", F.lit(key), "kind", "norm", F.col("attempt").cast("string"))
    at = _AT.format("i")
    shape = f"""array_join(transform(split(wide, ''), (c, i) -> case when i < first or i >= last then c
        when c between '0' and '9' then cast(case when i = first and kind = 'phone' then 2 + {at} % 8 else {at} % 10 end as string)
        when c between 'a' and 'z' then substr('abcdefghijklmnopqrstuvwxyz', {at} % (case when hexed then 6 else 26 end) + 1, 1)
        when c between 'A' and 'Z' then substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', {at} % 26 + 1, 1) else c end), '')"""
    octets = (f"array_join(transform(split(case when private > 0 and attempt >= {WIDER} then '10.0.0.0' else norm end, '[.]'), (o, i) -> "
              f"case when i < (case when attempt >= {WIDER} then least(private, 1) else private end) then o "
              f"when i = 0 then cast(11 + {at} % 112 as string) else cast(1 + {at} % 254 as string) end), '.')")
    # unique local addresses for private ones, the documentation range for others
    groups = ("concat_ws(':', case when private > 0 then concat('fd', substr(stream, 1, 2)) else '2001' end, "
              "case when private > 0 then substr(stream, 3, 4) else 'db8' end, transform(sequence(0, 5), i -> substr(stream, 4 * i + 7, 4)))")
    check = f"cast((10 - {_luhn('concat(left(shape, length(shape) - 1), 0)')} % 10) % 10 as string)"
    pools = " ".join(f"when kind = 'given_{g}_{s}' then lower(get({_array(v)}, {_AT.format('0')} % {len(v)}))" for (g, s), v in GIVEN.items())
    ending = "case when kind = 'given_f_latin' then 'a' when kind = 'given_f_cyrillic' then 'а' else '' end"
    return (rows.withColumn("stream", F.concat(*(F.sha2(F.concat_ws("|", seed, F.lit(str(i))), 256) for i in range(4))))
            # shape: digits for digits and letters for letters, between the places first and last
            .withColumn("first", F.expr("""case when kind = 'phone' then case when norm rlike '^[+][17]' then 2
                when norm rlike '^[+](2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])' then 3 when norm like '+%' then 4 when norm like '0%' then 1 else 0 end when kind = 'card' then 1 when kind = 'iban' then 2 else 0 end"""))
            .withColumn("hexed", F.expr("kind = 'secret' and norm rlike '^[0-9a-f]+$'"))
            .withColumn("more", F.expr(f"repeat(case when kind in ('email', 'secret') and not hexed then 'a' else '0' end, greatest(attempt - {WIDER - 1}, 0))"))
            .withColumn("wide", F.expr("case when kind = 'email' then concat(more, norm) else concat(norm, more) end"))
            .withColumn("last", F.expr("case when kind = 'email' then length(wide) - length(substring_index(wide, '.', -1)) else length(wide) end"))
            .withColumn("shape", F.expr(shape))
            .withColumn("private", F.expr("case when norm like '10.%' or norm like '127.%' then 1 when norm like '192.168.%' "
                                          "or norm rlike '^172[.](1[6-9]|2[0-9]|3[01])[.]' then 2 else 0 end"))
            .withColumn("new", F.expr(f"""case when kind = 'ip' then case when attempt >= {2 * WIDER} then {groups} else {octets} end
                when kind like 'given%' then concat(case {pools} else {_syllables('2')} end,
                    case when attempt > 0 then concat({_syllables('attempt')}, {ending}) else '' end)
                when kind like 'surname%' then {_syllables('3 + attempt')}
                when kind = 'card' then case when {_luhn('norm')} % 10 = 0 then concat(left(shape, length(shape) - 1), {check}) else shape end
                else shape end"""))
            .drop("stream", "first", "hexed", "more", "wide", "last", "shape", "private"))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, norm), distinct -> (kind, norm, new): keyed, distinct and no entity themselves."""
    real = entities.select("kind", F.col("norm").alias("new"), F.lit(True).alias("real"))
    drawn = written(draw(entities.withColumn("attempt", F.lit(0)), key), "surrogates")
    while True:
        winner = drawn.groupBy("kind", "new").agg(F.min(F.struct("attempt", "norm")).alias("best"))
        judged = (drawn.join(winner, ["kind", "new"]).join(real, ["kind", "new"], "left")
                  .withColumn("again", F.col("real").isNotNull() | (F.struct("attempt", "norm") != F.col("best"))))
        if judged.where("again").isEmpty():
            return drawn.select("kind", "norm", "new")
        anew = draw(judged.where("again").select("kind", "norm", (F.col("attempt") + 1).alias("attempt")), key)
        drawn = written(judged.where("not again").select(*anew.columns).unionByName(anew), "surrogates")


def replace_pii(docs: DataFrame, key: str, text_col: str = "text", count: str | None = "n_entities") -> DataFrame:
    """All columns of docs, the text replaced, and the number of entities appended as ``count`` (None: not), with
    underscores behind it if docs has a column of that name."""
    while count in docs.columns:
        count += "_"
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), F.col(text_col).alias("text"))
    marked = F.coalesce(F.expr(f"text rlike {_lit(MARKS)}"), F.lit(False))
    clean = rows.where(~marked).select("row", "text", F.lit(0).cast("long").alias("n_entities"))
    hits = written(rows.where(marked).withColumn("matches", F.expr(f"regexp_extract_all(text, {_lit(ANY)}, 0)"))
                   .withColumn("rid", F.monotonically_increasing_id()), "pii")
    kinds = hits.select("rid", F.posexplode("matches").alias("pos", "match")).withColumn("kind", F.expr(_kind("match")))
    parts = kinds.select("rid", "pos", F.posexplode(F.expr(_parts("match", "kind"))).alias("j", "part")).select("rid", "pos", "j", "part.*")
    entities = parts.where("kind is not null").select("kind", "norm").distinct()
    new = surrogates(entities, key).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    shown = (parts.withColumn("salt", F.pmod(F.xxhash64("rid", "pos"), F.lit(SALTS)).cast("int"))
             .join(new, ["kind", "norm", "salt"], "left").withColumn("shown", F.expr(_shown("kind", "new", "shown"))))
    per_match = shown.groupBy("rid", "pos").agg(F.array_sort(F.collect_list(F.struct("j", "shown"))).alias("p"))
    per_row = (per_match.withColumn("shown", F.array_join(F.col("p.shown"), " "))
               .groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("pos", "shown"))).alias("news")))
    rebuilt = (hits.join(per_row, "rid", "left").withColumn("news", F.col("news.shown"))
               .withColumn("text", F.expr(f"""case when size(matches) = 0 then text else array_join(transform(
                   split(text, {_lit(ANY)}, -1), (g, i) -> concat(g, coalesce(get(news, i), ''))), '') end"""))
               .select("row", "text", F.size("matches").cast("long").alias("n_entities")))
    out = clean.unionByName(rebuilt)
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns),
                      *([F.col("n_entities").alias(count)] if count else []))
