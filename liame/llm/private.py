"""Personal data of private people inside free text, found as scored spans and replaced by typed placeholders.

Regular expressions propose spans, checksum validators (Luhn, mod 97, the
check digits of Brazilian and Portuguese numbers) raise the score of a span
they confirm, and words nearby raise or lower it. A failed checksum lowers
nothing: numbers are mistyped, and a number with a label stays personal. Given
names are those listed and those the collection shows: words that stand before
another capitalised word and follow a title or a phrase that introduces people.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liame.plans.parallel import spread
from liame.sources.tables import load

KINDS = ("email", "id_number", "phone", "address", "name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[TELEFONE]", "id_number": "[DOCUMENTO]", "address": "[ENDEREÇO]", "name": "[NOME]"}
ACCEPT = 0.5
LARGEST_PERSONS = 1_000_000  # spellings of public persons up to which all go to every task; beyond, each document brings its own
INTRODUCED, SHARE = 5, 0.2  # how often, and in what share of its places, a word must be introduced as a person's to be a given name

# Common given names of the Portuguese-speaking world, without accents.
GIVEN = set(
    "adriana adriano alberto alessandra alexandre alice aline amanda ana anderson andre andrea angela antonia antonio arthur augusto "
    "barbara beatriz benedito bernardo bianca bruna bruno camila carla carlos carolina catarina cecilia celia celso cesar cicero clara "
    "claudia claudio conceicao cristiane cristina daniel daniela debora denise diego diogo edson eduardo elaine eliana elisa emilia enzo "
    "fabiana fabio felipe fernanda fernando filipe flavia flavio francisca francisco frederico gabriel gabriela geraldo gilberto giovanna "
    "guilherme gustavo helena heloisa henrique hugo igor ines ingrid irene isabel isabela ivan jacqueline joana joao joaquim jorge jose "
    "josefa juliana julio karina laura leandro leonardo leticia lidia livia lourdes luana lucas lucia luciana luis luisa luiz manuel "
    "manuela marcelo marcia marcio marcos margarida maria mariana marina mario marta mateus matheus mauricio miguel monica natalia neuza "
    "nicolas otavio patricia paula paulo pedro philippe priscila rafael rafaela raimunda raimundo raquel renata renato ricardo roberta "
    "roberto rodrigo rogerio rosa rosana ruth sandra sebastiana sebastiao sergio silvia simone sofia sonia tatiana teresa terezinha "
    "thereza thiago tiago tomas valeria vanessa vera vicente victor vinicius vitoria viviane wagner walter wellington william"
    .split()
)
PARTICLES = {"de", "da", "do", "dos", "das", "del"}
TITLES = set("dr dra doutor doutora prof professor professora sr sra senhor senhora dona seu coronel general capitao major padre dom frei ministro ministra senador senadora deputado deputada vereador vereadora governador governadora presidente desembargador juiz juiza perita relator relatora promotor delegado".split())
INSTITUTIONS = set("escola colegio hospital lei premio instituto fundacao universidade faculdade creche biblioteca museu teatro estadio ponte viaduto parque aeroporto terminal estacao centro edificio condominio conjunto bairro vila jardim medalha trofeu taca ordem comenda programa operacao associacao federacao sindicato cooperativa consorcio movimento banco igreja paroquia ginasio unidade maternidade clube comarca municipio cidade plano emenda decreto caso sumula".split())
STREETS = set("rua r avenida av alameda al travessa tv praca largo estrada rodovia beco ladeira viela calcada calle".split())
# Words that begin sentences and headings and are no part of a name.
STARTERS = set("a o as os um uma em no na nos nas para por com sem sob segundo se que quem quando como onde ainda tambem assim este esta isso nao sim meu minha seus fica ficam retirar letters the for officials analysts me se el la los las en un una houve ha foi sao eu voce nota tel telefone cel fone email contato att atenciosamente cpf rg edital intimacao processo segunda terca quarta quinta sexta sabado domingo janeiro fevereiro marco abril maio junho julho agosto setembro outubro novembro dezembro".split())

SEP = r"(?:@|\s@\s|\s?[(\[]\s?(?:arroba|at)\s?[)\]]\s?)"
DOT = r"(?:\.|\s?[(\[]\s?(?:ponto|dot|punto)\s?[)\]]\s?)"
EMAIL = re.compile(rf"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]*{SEP}[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)+", re.I)
PHONES = (
    (re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(?\d{2,3}\)?[ .-]?)?\d(?:[ .-]?\d){6,10}(?!\d)"), 0.6),
    (re.compile(r"(?<!\w)\(0?\d{2}\) ?(?:9[ .-]?)?\d{4}[ .-]?\d{4}(?![\d/]|[.,-]\d)"), 0.6),
    (re.compile(r"(?<![\w.,/+(-])0?\d{2}[ -](?:9[ .-]?)?\d{4}[ .-]\d{4}(?![\w/]|[.,-]\d)"), 0.5),
    (re.compile(r"(?<![\w.,/+(-])0?\d{2}9\d{8}(?![\w/]|[.,-]\d)"), 0.2),
    (re.compile(r"(?<![\w.,/+(-])(?:9[ .-]?)?\d{4}-\d{4}(?![\w/]|[.,-]\d)"), 0.2),
)
IDS = (
    (re.compile(r"(?<![\w.,/-])\d{3}\.\d{3}\.\d{3}-\d{2}(?![\w/]|[.-]\d)"), 0.6),
    (re.compile(r"(?<![\w.,/-])\d{1,2}\.\d{3}\.\d{3}-[\dXx](?![\w/]|[.-]\d)"), 0.5),
    (re.compile(r"(?<![\w.,/-])\d{3}[ .]\d{5}[ .]\d{2}[ -]\d(?![\w/]|[.-]\d)"), 0.4),
    (re.compile(r"(?<![\w.,/-])\d{3} \d{3} \d{3} \d{2}(?![\w/]|[ .-]\d)"), 0.4),
    (re.compile(r"(?<![\w.,/-])\d{4} \d{4} \d{4}(?: \d{4})?(?![\w/]|[ .-]\d)"), 0.2),
    (re.compile(r"(?<![\w.,/-])[A-Z]{1,3} ?\d{6,8}(?![\w/]|[.-]\d)"), 0.2),
    (re.compile(r"(?<![\w.,/-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"), 0.1),
    (re.compile(r"(?<![\w.,/-])\d{8,12}(?:-?[\dXx])?(?![\w/]|[.-]\d)"), 0.2),
)
ID_LABEL = re.compile(r"(?:\bC\.? ?P\.? ?F\b\.?|\bR\.? ?G\b\.?|\bpassaporte|\bpassport|\bt[ií]tulo(?: de eleitor)?|\bNIF|\bNIS|\bPIS|\bPASEP|\bCNH|\bDNI|\bNIE|\bCNS|\bcart[ãa]o(?: [\w-]+){0,3}|\bc[ée]dula|\b(?:carteira|documento|n[úu]mero) de identidade|\bidentidade|\bIBAN)\W{0,3}(?:(?:n\.? ?[ºo°]\.?|n[úu]mero|no\.)\W{0,2})?$", re.I)
ID_NOT = re.compile(r"(?:\bprocesso|\binscri[çc][ãa]o|\bprotocolo|\bCNPJ|\bLei|\bPL|\bPEC|\bR\$|\bportaria|\bcontrato|\bedital|\bnota)\W{0,3}(?:n\.? ?[ºo°]\.?\W{0,2})?$", re.I)
PHONE_NEAR = re.compile(r"\b(?:tel|tele[fm][oó]ne?|telefone|fone|cel|celular|zap|whats\w*|n[úu]mero|lig(?:ar|ou|ue)\w*|contato|phone|call)\b[^.!?\n]{0,18}$", re.I)
NUMBER = r"(?:\d{1,3}\.\d{3}|\d{1,5})(?![\d/]|[.,-]\d)"
ADDRESS = re.compile(
    r"(?<![\w.])(?:rua|r\.|avenida|av\.?|alameda|al\.|travessa|tv\.|praça|pça\.?|largo|estrada|rodovia|beco|ladeira|viela|calçada|calle)"
    r"(?: (?:[ddD][aeoAEO][sS]?|e|\d{1,2}|(?-i:[A-ZÀ-Þ])[\w'’.-]*)){1,7}?"
    rf",? (?:(?:n\.? ?[ºo°]\.?|n[úu]mero|num\.?|no\.) ?)?{NUMBER}",
    re.I,
)
NAME_RUN = re.compile(r"(?<![\w@#.])[A-ZÀ-Þ][\wÀ-ÿ'’-]+(?: (?:(?:[dD][aeoAEO][sS]?|del|e|E) )?[A-ZÀ-Þ][\wÀ-ÿ'’-]+)+")
NAME_BEFORE = re.compile(r"(?:meu nome [ée]|me llamo|my name is|att\.,|atenciosamente,|cuidados de|falar com|morador[ae]?|aposentad[oa]|comiss[ãa]o|intima[çc][ãa]o:|assinam? a carta|nomead[oa]|vizinh[oa]|v[ií]tima|testemunha|cidad[ãa]o?|estudante|paciente|aluno|aluna|chamad[oa])\s*$", re.I)
NAME_AFTER = re.compile(r"\s*(?:[,;-]? ?(?:CPF|C\.P\.F|RG|passaporte|t[ií]tulo de)|, residente|, morador|, de \d{1,3} anos|, portador)", re.I)


LONG = re.compile(r"\d(?:[ .()/-]{0,3}\d){5,}")  # no number of a person has fewer digits in a row
DIGIT = re.compile(r"\d")
HIDDEN = re.compile(r"@|[(\[]\s?(?:arroba|at)\s?[)\]]", re.I)
# Words after which a person is introduced, without accents.
INTRODUCES = TITLES | set("chamado chamada morador moradora vizinho vizinha aposentado aposentada vitima testemunha cidada cidadao estudante paciente aluno aluna nome llamo".split())


def plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def mod97(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _mod11(digits: str, weights: range | list[int]) -> int:
    rest = sum(int(d) * w for d, w in zip(digits, weights)) * 10 % 11
    return 0 if rest == 10 else rest


def checked(span: str) -> bool:
    """Whether a known checksum confirms the number."""
    core = re.sub(r"[ .\-/]", "", span).upper()
    if core.isdigit():
        if len(core) == 11 and len(set(core)) > 1:
            if _mod11(core[:9], range(10, 1, -1)) == int(core[9]) and _mod11(core[:10], range(11, 1, -1)) == int(core[10]):
                return True
            return _mod11(core[:10], [3, 2, 9, 8, 7, 6, 5, 4, 3, 2]) == int(core[10])
        if len(core) == 9:
            return _mod11(core[:8], range(9, 1, -1)) == int(core[8])
        if 13 <= len(core) <= 19:
            return luhn(core)
        return False
    if re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", core):
        return mod97(core)
    return False


class Finder:
    """Finds the pieces of a text.

    ``tracked`` are the folded spellings of public persons, ``starters`` folded
    words that begin sentences, ``given`` given names beside the listed ones.
    """

    def __init__(self, tracked: set[str], starters: set[str], given: set[str] = frozenset()) -> None:
        self.public(tracked)
        self.starters = (STARTERS | starters) - GIVEN - PARTICLES
        self.given = GIVEN | (given - self.starters - INSTITUTIONS - STREETS - TITLES - PARTICLES)

    def public(self, tracked: set[str]) -> None:
        self.tracked = tracked
        self.longest = max((t.count(" ") + 1 for t in tracked), default=0)

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Accepted spans (start, end, kind) in order, none over another."""
        found: list[tuple[float, int, int, str]] = []
        if HIDDEN.search(text):
            found += [(0.9, m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
        if LONG.search(text):
            for pattern, base in IDS:
                for m in pattern.finditer(text):
                    before = text[max(0, m.start() - 40) : m.start()]
                    score = base + 0.4 * bool(ID_LABEL.search(before)) - 0.6 * bool(ID_NOT.search(before)) - 0.3 * bool(PHONE_NEAR.search(before) and not ID_LABEL.search(before))
                    score += 0.3 * (base > 0.15 and score >= 0.3 and checked(m.group())) + 0.5 * (base <= 0.15 and checked(m.group()))
                    found.append((score, m.start(), m.end(), "id_number"))
            for pattern, base in PHONES:
                for m in pattern.finditer(text):
                    before = text[max(0, m.start() - 40) : m.start()]
                    score = base + 0.35 * bool(PHONE_NEAR.search(before)) - 0.6 * bool(ID_LABEL.search(before) or ID_NOT.search(before))
                    found.append((score, m.start(), m.end(), "phone"))
        if DIGIT.search(text):
            found += [(0.8, m.start(), m.end(), "address") for m in ADDRESS.finditer(text)]
        taken: list[tuple[int, int, str]] = []
        for score, a, b, kind in sorted(found, key=lambda x: (-x[0], x[1], -x[2])):
            if score >= ACCEPT and all(b <= x or y <= a for x, y, _ in taken):
                taken.append((a, b, kind))
        for a, b in self.names(text):
            if all(b <= x or y <= a for x, y, _ in taken):
                taken.append((a, b, "name"))
        return sorted(taken)

    def names(self, text: str) -> Iterator[tuple[int, int]]:
        for run in NAME_RUN.finditer(text):
            words = [(m.start() + run.start(), m.end() + run.start(), m.group()) for m in re.finditer(r"[^ ]+", run.group())]
            low = [plain(w) for _, _, w in words]
            public = self._public(low)
            i = 0
            while i < len(words):
                if public[i] or low[i] in PARTICLES or low[i] == "e" or low[i] in self.starters:
                    i += 1
                    continue
                j, upper = i + 1, words[i][2].isupper()
                while j < len(words) and not public[j] and low[j] != "e" and low[j] not in self.starters and (low[j] in PARTICLES or words[j][2].isupper() == upper):
                    j += 1
                yield from self._segment(text, words, low, i, j)
                i = j

    def _public(self, low: list[str]) -> list[bool]:
        """Which words belong to a spelling of a public person, the longest first."""
        out = [False] * len(low)
        i = 0
        while i < len(low):
            for n in range(min(self.longest, len(low) - i), 0, -1):
                if " ".join(low[i : i + n]) in self.tracked:
                    out[i : i + n] = [True] * n
                    i += n
                    break
            else:
                i += 1
        return out

    def _segment(self, text: str, words: list, low: list[str], i: int, j: int) -> Iterator[tuple[int, int]]:
        while j > i and low[j - 1] in PARTICLES:
            j -= 1
        start = next((k for k in range(i, j) if low[k] in self.given), None)
        before = text[max(0, words[i][0] - 30) : words[i][0]]
        if start is None:
            start = i
            while start < j and low[start] in TITLES:
                start += 1
            if j - start < 2 or not (NAME_BEFORE.search(before) or NAME_AFTER.match(text, words[j - 1][1])):
                return
            if low[start] in INSTITUTIONS or low[start] in STREETS:
                return
        if sum(1 for k in range(start, j) if low[k] not in PARTICLES) < 2:
            return
        # The words before: titles fall away, an institution or a street makes the name its own.
        ahead = low[max(0, start - 4) : start] if start > 0 else []
        outside = re.findall(r"[\w]+", plain(text[max(0, words[0][0] - 24) : words[0][0]]).rpartition("\n")[2])
        if re.search(r"[!?;:”\"]\s*$|(?<!\b[rR])(?<!\b[aA][vV])\.\s*$", text[max(0, words[0][0] - 4) : words[0][0]]):
            outside = []
        chain = [w for w in outside + ahead if w not in PARTICLES]
        while chain and chain[-1] in TITLES:
            chain.pop()
        score = 0.5
        if chain and (chain[-1] in INSTITUTIONS or chain[-1] in STREETS):
            score -= 0.6
        score += 0.3 * bool(NAME_BEFORE.search(before)) + 0.3 * bool(NAME_AFTER.match(text, words[j - 1][1]))
        if score >= ACCEPT:
            yield words[start][0], words[j - 1][1]


def _starters(documents: DataFrame) -> set[str]:
    """Words that begin a sentence in half of their capitalised occurrences or more, over all documents.

    Only words in at least one of 500 documents (and 10 occurrences) are kept,
    so there are at most 500 times as many as a document has different words.
    """
    n = documents.count()
    words = documents.select(
        F.explode(F.regexp_extract_all("text", F.lit(r"((?:^|[.!?…:;”\"\n]\s*|[-–—] )?\b\p{Lu}[\p{L}]+)"), 1)).alias("w")
    )
    counts = (
        words.select("w", F.ltrim("w", F.lit(".!?…:;”\"-–— \t\n\x0b\f\r")).alias("word")).select("word", F.when(F.col("w") != F.col("word"), 1).otherwise(0).alias("first"))
        .groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("first").alias("first"))
        .where((F.col("n") >= max(10, n // 500)) & (F.col("first") >= 0.5 * F.col("n")))
    )
    return {plain(r["word"]) for r in counts.select("word").collect()}


def _given(documents: DataFrame) -> set[str]:
    """Words before another capitalised word that often follow a title or an introduction, over all documents.

    Kept are words introduced in at least one of 20 000 documents, so what is
    collected is at most 20 000 times what a document introduces.
    """
    least = max(INTRODUCED, documents.count() // 20_000)
    pairs = documents.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<!\p{L})(\p{L}+\.? )?(\p{Lu}\p{Ll}+) (?:d[aeo]s? )?\p{Lu}\p{Ll}"), 0)).alias("x"))
    # The parts from the end: the next name's beginning, perhaps a particle, the word, perhaps the word before.
    parts = F.split("x", " ")
    at = F.when(F.substring(F.element_at(parts, -2), 1, 1) == "d", 3).otherwise(2)
    first, before = F.element_at(parts, -at), F.rtrim(F.try_element_at(parts, -at - 1), F.lit("."))
    accented = F.translate(F.lower(before), "áàâãéêíóôõúç", "aaaaeeiooouc")
    counts = pairs.groupBy(first.alias("word")).agg(F.count(F.lit(1)).alias("n"), F.count_if(accented.isin(sorted(INTRODUCES))).alias("introduced"))
    return {plain(r["word"]) for r in counts.where((F.col("introduced") >= least) & (F.col("introduced") >= SHARE * F.col("n"))).select("word").collect()}


def _finder(documents: DataFrame, persons: DataFrame):
    """(doc_id, text, public) and the broadcast (public spellings, sentence starters, given names).

    ``public`` is null where the spellings are broadcast; where persons are too
    many for that, it has those of the document, from a join on its runs of capitalised words.
    """
    texts = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    spellings = persons.select(F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).where("name is not null").distinct()
    rows = spellings.limit(LARGEST_PERSONS + 1).collect()
    fold = lambda name: plain(" ".join(name.split()))
    if len(rows) <= LARGEST_PERSONS:
        tracked = {fold(r["name"]) for r in rows}
        spread_texts = spread(texts.withColumn("public", F.lit(None).cast("array<string>")))
    else:
        del rows
        folded = F.pandas_udf(lambda s: s.map(fold), "string")
        known = spellings.select(folded("name").alias("gram")).distinct()
        longest = known.agg(F.max(F.size(F.split("gram", " ")))).first()[0]

        def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = set()
                for d, t in zip(batch["doc_id"], batch["text"]):
                    for run in NAME_RUN.finditer(t):
                        low = [plain(w) for w in run.group().split(" ")]
                        out.update((d, " ".join(low[i : i + n])) for i in range(len(low)) for n in range(1, min(longest, len(low) - i) + 1))
                yield pd.DataFrame(sorted(out), columns=["doc_id", "gram"])

        own = texts.mapInPandas(grams, "doc_id long, gram string").join(known, "gram").groupBy("doc_id").agg(F.collect_set("gram").alias("public"))
        tracked = set()
        spread_texts = texts.join(own, "doc_id", "left").withColumn("public", F.coalesce("public", F.array().cast("array<string>")))
    return spread_texts, documents.sparkSession.sparkContext.broadcast((tracked, _starters(texts), _given(texts)))


def _spans(finder: Finder, text: str, public) -> list[tuple[int, int, str]]:
    if public is not None:
        finder.public(set(public))
    return finder.spans(text)


def personal_data(documents: DataFrame, persons: DataFrame) -> DataFrame:
    """(doc_id, kind, piece): each distinct piece of personal data of each document, as written.

    ``documents`` has (doc_id, text); null texts hold nothing, repeated rows
    count once. ``persons`` (name, aliases) are public: their names are no case.
    """
    texts, shared = _finder(documents, persons)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(*shared.value)
        for batch in batches:
            rows = {(d, kind, t[a:b]) for d, t, public in zip(batch["doc_id"], batch["text"], batch["public"]) for a, b, kind in _spans(finder, t, public)}
            yield pd.DataFrame(sorted(rows), columns=["doc_id", "kind", "piece"])

    return texts.mapInPandas(find, "doc_id long, kind string, piece string").distinct()


def redacted(documents: DataFrame, persons: DataFrame) -> DataFrame:
    """(doc_id, text, n_replaced): the texts with every span replaced by its placeholder, the rest as it was."""
    texts, shared = _finder(documents, persons)

    def replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(*shared.value)
        for batch in batches:
            texts, counts = [], []
            for t, public in zip(batch["text"], batch["public"]):
                spans, parts, at = _spans(finder, t, public), [], 0
                for a, b, kind in spans:
                    parts += [t[at:a], PLACEHOLDER[kind]]
                    at = b
                texts.append("".join([*parts, t[at:]]))
                counts.append(len(spans))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": texts, "n_replaced": counts})

    return texts.mapInPandas(replace, "doc_id long, text string, n_replaced long")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data(load(spark, folder, "documents"), load(spark, folder, "persons"))


def p10_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return redacted(load(spark, folder, "documents"), load(spark, folder, "persons"))


QUERIES = {"p10_found": p10_found, "p10_redacted": p10_redacted}
SQL: dict[str, str] = {}
