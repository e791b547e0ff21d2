"""Natural language hidden inside code (problem 6).

Method: comments and string literals are cut out by *delimiter families* (slash, hash, dash, quotes, blocks),
so languages without a parser are served alike; adjacent comment lines are merged where a sentence runs on;
each sentence is classified by the *distance of ranked n-gram profiles*, with rejection.

The profiles rank letter n-grams (1 to 4, with word ends) of the sample texts below, letters folded to their base;
words with accents are counted a second time without those letters and with their transcription, since files lose
accents in either way. The distance of a sentence to a language is the mean rank of its n-grams there, an absent one
counting as the last rank. A sentence is rejected if even its nearest profile is far, or if its lead over English,
times the root of its number of words, is small: a mean over more words strays less. Names in code are mostly English
words, so the English sample holds such words too. Scripts decide ru, zh and ja before that. Every comment and string
of every line goes through the profiles; nothing is sifted by words beforehand.

Comment lines of one kind that follow each other are one text. A line begins a new sentence if the line before ends
one, or if both lines alone are clearly of different languages.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "nl")
REPORTED = frozenset(("de", "fr", "es", "pt", "ru", "zh", "ja"))
MIN_WORDS, MIN_DENSE = 5, 8
RANKS = 1500
#: Rejection: largest mean rank (of 1) to the nearest profile, and least lead over English times the root of the words.
MAX_DISTANCE, MIN_LEAD = 0.5, 0.125

# Sample texts the profiles are trained on, written for this purpose.
SAMPLES = {
    "en": """the and of to a in is it for that with as on are this be at by an or from not have which when will if only all
    one each before after under over while where because without until instead than more other its their there was has been
    every request is checked before the result gets stored in the table, because later steps rely on it. we never remove a
    record while another process still reads it. the next run starts after all files have been written and the lock is free.
    this function returns the number of rows or nothing if the connection was lost. callers should keep the order of entries
    for large projects the cache is filled in the background so that nobody has to wait. do not change these values by hand
    under load the worker keeps one shared buffer and its queue alongside the index rather than guessing a default value
    nothing else may touch this shard during the scan. in practice older clients still expect that both sides agree on it
    most of these options are read at startup and written to the log with a short note about what was skipped or dropped
    import from return value type name path file line list index token queue cache node graph edge chunk parcel replica tenant segment
    socket corpus label metric schema lease record buffer digest manifest session vector window worker ledger module package imports
    symbols functions types parse trim evict detach validate rank merge fetch flush encode decode publish restore replay route sample score
    prune lib core json errors sort fs os error message default config number string object array query batch snapshot cursor offset
    delta prefix probe quota ticket voucher""",
    "de": """der die das und ist nicht mit auf für ein eine einen einem einer den dem des von zu im sich auch wird sind als an nach wie aus bei
    oder nur noch über wenn werden kann hat bis durch keine jeder jede jeden alle diese dieser dieses ohne damit weil während
    bevor sobald falls obwohl statt unser unsere sehr mehr man wir sie es er zum zur vom beim
    jede anfrage wird geprüft bevor das ergebnis in der tabelle gespeichert wird, weil spätere schritte darauf bauen. wir löschen
    niemals einen eintrag während ein anderer prozess ihn noch liest. der nächste lauf startet nachdem alle dateien geschrieben
    wurden und die sperre wieder frei ist. diese funktion liefert die anzahl der zeilen oder nichts falls die verbindung abbricht
    für große projekte füllt sich der speicher im hintergrund damit niemand lange warten muss. die werte bitte nicht von hand ändern
    die reihenfolge der einträge bleibt gleich. veraltete abschnitte werden übersprungen, größere blöcke geteilt und das schema ersetzt
    der arbeiter meldet den zustand und zählt die fehler. das verzeichnis öffnet den schlüssel, verwirft doppelte und sammelt den rest
    erzeugt automatisch aus der vorlage, änderungen gehen beim nächsten bau verloren fuer ueber aenderungen naechsten groesste""",
    "fr": """le la les de des du un une et est en que qui dans pour pas sur au aux avec par ce cette ces son sa ses il elle nous vous on ne plus
    ou mais si sans tout tous toutes chaque aucun leur être sont a été fait même après avant dès lorsque quand afin parce pendant
    notre nos jusqu d l qu n s c j
    chaque requête est vérifiée avant que le résultat soit enregistré dans la table, parce que les étapes suivantes en dépendent. nous
    ne supprimons jamais une ligne pendant qu'un autre processus la lit encore. la prochaine exécution commence dès que tous les fichiers
    sont écrits et que le verrou est libéré. cette fonction renvoie le nombre de lignes ou rien si la connexion est perdue. pour les
    grands projets le cache se remplit en arrière-plan afin que personne ne doive attendre. ne pas modifier ces valeurs à la main
    l'ordre des entrées reste le même. les anciens morceaux sont ignorés, les plus gros blocs divisés et le schéma remplacé au démarrage
    le compteur compare le chemin complet puis écrit une note. le répertoire ouvre la clé, rejette les doublons et rassemble le reste
    fichier généré automatiquement à partir du modèle, les changements seront perdus lors de la prochaine construction""",
    "es": """el la los las de del un una y es en que no se por con para su al lo como más o pero sus le ya este esta estos estas sin sobre
    también hasta desde cuando muy todo toda todos todas cada ningún ninguna nadie otro otra otros otras entre porque antes después
    mientras aunque si nuestra nuestro solo sólo hay fue ser son está donde quien
    cada consulta se comprueba antes de que el resultado se guarde en la tabla, porque los pasos siguientes dependen de ello. nunca
    borramos una fila mientras otro proceso todavía la lee. la próxima ejecución empieza cuando todos los archivos están escritos y el
    bloqueo queda libre. el resultado de la búsqueda se lee al final de la tarea. el grafo de las llamadas queda en la memoria. esta función devuelve el número de filas o nada si se corta la conexión. en los proyectos grandes la caché se
    llena en segundo plano para que nadie tenga que esperar. no cambiar estos valores a mano
    el orden de las entradas sigue igual. los trozos antiguos se omiten, los bloques más grandes se dividen y el esquema se reemplaza
    el contador compara la ruta completa y escribe una nota. el directorio abre la clave, rechaza los duplicados y reúne el resto
    archivo generado automáticamente a partir de la plantilla, los cambios se perderán en la siguiente compilación""",
    "pt": """o a os as de do da dos das um uma e é em no na nos nas que não se por com para seu sua ao aos mais ou mas como já este esta estes
    estas isso sem sobre também até desde quando muito todo toda todos todas cada nenhum nenhuma ninguém outro outra outros outras entre
    porque antes depois enquanto embora nosso nossa só apenas há foi ser são está onde quem pelo pela num numa
    cada pedido é verificado antes que o resultado seja guardado na tabela, porque os passos seguintes dependem disso. nunca apagamos uma
    linha enquanto outro processo ainda a lê. a próxima execução começa quando todos os arquivos estão escritos e o bloqueio fica livre
    esta função devolve o número de linhas ou nada se a conexão cair. em projetos grandes o cache enche em segundo plano para que
    ninguém precise esperar. não alterar estes valores à mão. o resultado da busca é lido no fim da tarefa, antes que a próxima termine
    o grafo das chamadas, o registro do erro e a função de leitura ficam na memória do servidor. a tarefa termina quando o teste acaba
    a ordem das entradas continua igual. os pedaços antigos são ignorados, os blocos maiores divididos e o esquema substituído
    o contador compara o caminho completo e escreve uma nota. o diretório abre a chave, rejeita os repetidos e reúne o restante
    arquivo gerado automaticamente a partir do modelo, as alterações serão perdidas na próxima compilação""",
    "it": """il lo la i gli le di del della dei delle un uno una e è in che non si per con da al alla come più o ma anche questo questa sono
    ogni richiesta viene controllata prima che il risultato sia salvato nella tabella, perché i passi successivi ne dipendono. non cancelliamo
    mai una riga mentre un altro processo la legge ancora. questa funzione restituisce il numero di righe oppure niente se la connessione cade
    per i progetti grandi la cache si riempie in secondo piano così nessuno deve aspettare. l'ordine degli elementi resta uguale senza cambiare""",
    "nl": """de het een en van in is dat op te zijn met voor niet aan er om ook als dan maar bij nog uit door over naar of wordt worden deze dit
    elk verzoek wordt gecontroleerd voordat het resultaat in de tabel wordt opgeslagen, omdat latere stappen ervan afhangen. wij verwijderen
    nooit een rij terwijl een ander proces die nog leest. deze functie geeft het aantal rijen terug of niets als de verbinding wegvalt
    voor grote projecten vult de buffer zich op de achtergrond zodat niemand hoeft te wachten. de volgorde van de regels blijft gelijk""",
}
_UNICODE = re.compile(r"\\u\{([0-9a-fA-F]{1,6})\}|\\u([0-9a-fA-F]{4})|\\U([0-9a-fA-F]{8})|\\x([0-9a-fA-F]{2})|((?:\\x[0-9a-fA-F]{2}){2,})")
_BYTES = re.compile(r"(?:\\x[0-9a-fA-F]{2})+")
_ENTITY = re.compile(r"&(?:#\d{2,7}|#x[0-9a-fA-F]{2,6}|[a-zA-Z]{3,8});")

# Delimiter families: a string on one line, a comment to the end of the line, leaders of comment lines.
_QUOTED = re.compile(r"\"((?:[^\"\\\n]|\\.)*)\"|(?<![\w])'((?:[^'\\\n]|\\.)*)'(?!\w)|`((?:[^`\\\n]|\\.)*)`")
_TRAIL = re.compile(r"(?:^|(?<=[\s;{}),]))(?://+!?|/\*+!?|#+!?|---?|--\[=*\[|<!--|;+|%+|=begin)(?=\s|$|[^\W\d]|@|\\|:)")
_LINE_HEAD = re.compile(r"^\s*(?://+!?|/\*+!?|\*+/?|#+!?|---?\[=*\[|---?|<!--|;+|%+|\"\"\"|'''|r\"\"\"|[rRuUbB]?\"{3}|'{3})?\s?")
_TAGS = re.compile(r"[@\\](?:param|arg|tparam|throws|exception|raises?|returns?|see|brief|details|note|type|yields?|prop(?:erty)?)\b(?:[ \t]*\{[^}\n]*\})?(?:[ \t]+[\w$.\[\]*]+(?=\s))?|:(?:param|type|raises?|returns?|rtype|var)\b[^:\n]*:")
_CONFIG_VALUE = re.compile(r"^\s*(?:export\s+|-\s+)?[\"']?[\w.\-/ ]{1,80}?[\"']?\s*[:=]\s*(.+?)\s*,?\s*$")
_SENTENCE_END = re.compile(r"(?<=[.!?;。！？；…])(?:\s+|(?=[^\x00-\x7f]))|\s+[|·•]\s+")
_ENDED = re.compile(r"[.!?:;。！？；…]\W*$")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CODE = re.compile(r"\w\.[A-Za-z]\w*(?:\.|,|$)|[=<>{}\[\]|&;$@^~]|\w\(|\w\.\w+\(|::|->|\w_\w")
_DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")
_KANA = re.compile(r"[\u3040-\u30ff]")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]{2,}|(?<![Ѐ-ӿ])[Ѐ-ӿ](?![Ѐ-ӿ])")
_OTHER_SLAVIC = re.compile(r"[іїєґўІЇЄҐЎђћџљњјѓќ]")
_FOREIGN_DENSE = re.compile(r"[\uac00-\ud7af\u0e00-\u0e7f]")


def fold(text: str) -> str:
    """Lower-case letters without accents."""
    text = text.lower().replace("ß", "ss").replace("œ", "oe").replace("æ", "ae")
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _variants(word: str) -> list[str]:
    """A word of a sample as files hold it: folded and, if it has accents, without them or transcribed."""
    if word.isascii():
        return [word.lower()]
    lower = word.lower()
    bare = "".join(c for c in lower if c.isascii())
    spelled = lower.replace("ä", "ae").replace("ö", "oe").replace("ü", "ue")
    return [v for v in (fold(lower), bare, fold(spelled)) if v]


def _grams(words: list[str]) -> list[str]:
    out = []
    for w in words:
        w = f"_{w}_"
        n = len(w)
        out += [w[i : i + 1] for i in range(1, n - 1)]
        for size in (2, 3, 4):
            out += [w[i : i + size] for i in range(n - size + 1)]
        if n <= 6:
            out += [w, w]  # whole short words are the strongest marks
    return out


class Profiles:
    """Ranks of n-grams per language, as rows of one table."""

    def __init__(self) -> None:
        ranked = []
        for lang in LANGUAGES:
            counts = Counter(_grams([v for w in _WORD.findall(SAMPLES[lang]) for v in _variants(w)]))
            order = sorted(counts, key=lambda g: (-counts[g], g))[:RANKS]
            ranked.append({g: i / RANKS for i, g in enumerate(order)})
        names = sorted(set().union(*ranked))
        self.row = {g: i + 1 for i, g in enumerate(names)}
        self.table = np.ones((len(names) + 1, len(LANGUAGES)))
        for k, ranks in enumerate(ranked):
            for g, v in ranks.items():
                self.table[self.row[g], k] = v
        self.known: dict[str, str | None] = {}
        self.sums: dict[str, tuple[np.ndarray, int]] = {}

    def distances(self, words: list[str]) -> np.ndarray:
        total, n = np.zeros(len(LANGUAGES)), 0
        for w in words:
            held = self.sums.get(w)
            if held is None:
                rows = [self.row.get(g, 0) for g in _grams([fold(w)])]
                held = self.table[rows].sum(axis=0), len(rows)
                if len(self.sums) > 100_000:
                    self.sums.clear()
                self.sums[w] = held
            total += held[0]
            n += held[1]
        return total / n

    def latin(self, words: list[str]) -> str | None:
        """The language of a sentence in Latin letters, or None."""
        key = " ".join(words)
        if key in self.known:
            return self.known[key]
        d = self.distances(words)
        k = int(np.argmin(d))
        near = d[k] <= MAX_DISTANCE and (k == 0 or (d[0] - d[k]) * len(words) ** 0.5 >= MIN_LEAD)
        lang = LANGUAGES[k] if near else None
        if len(self.known) > 200_000:
            self.known.clear()
        self.known[key] = lang
        return lang


_profiles: Profiles | None = None


def profiles() -> Profiles:
    global _profiles
    if _profiles is None:
        _profiles = Profiles()
    return _profiles


def unescape(text: str) -> str:
    """Escapes of strings and entities replaced by their characters."""
    if "\\" in text:
        if "\\x" in text:
            def raw(m: re.Match) -> str:
                data = bytes.fromhex(m.group().replace("\\x", ""))
                try:
                    return data.decode("utf-8")
                except UnicodeDecodeError:
                    return data.decode("latin-1")

            text = _BYTES.sub(raw, text)
        if "\\u" in text or "\\U" in text:
            def code(m: re.Match) -> str:
                v = int(next(g for g in m.groups()[:3] if g), 16)
                return chr(v) if v < 0x110000 else " "

            text = _UNICODE.sub(lambda m: code(m) if any(m.groups()[:3]) else m.group(), text)
            try:  # surrogate pairs
                text = text.encode("utf-16", "surrogatepass").decode("utf-16")
            except UnicodeDecodeError:
                pass
        text = re.sub(r"\\[nrt]", " ", text)
        text = re.sub(r"\\([\"'`\\])", r"\1", text)
    if "&" in text:
        import html

        text = _ENTITY.sub(lambda m: html.unescape(m.group()), text)
    return text


def language(sentence: str) -> str | None:
    """The language of one sentence, ``en`` included, or None for code, short and unsure text."""
    if sentence.isascii() and sentence.count(" ") < MIN_WORDS - 2:
        return None  # fewer words than a sentence has
    dense = len(_DENSE.findall(sentence))
    if dense >= MIN_DENSE:
        if len(_FOREIGN_DENSE.findall(sentence)) > dense:
            return None
        kana = len(_KANA.findall(sentence))
        return "ja" if kana * 8 >= dense else "zh"
    words = _WORD.findall(sentence)
    if len(words) < MIN_WORDS:
        return None
    cyrillic = _CYRILLIC.findall(sentence)
    if len(cyrillic) >= MIN_WORDS:
        return None if _OTHER_SLAVIC.search(sentence) else "ru"
    latin = [w for w in words if w[0] < "ɐ"]
    # words stand apart and are not mostly single letters; encoded data and split bytes are no sentences
    if "\x00" in sentence or sentence.count(" ") < MIN_WORDS - 2 or sum(map(len, latin)) < 2.6 * len(latin):
        return None
    if len({w.lower() for w in latin}) < MIN_WORDS or len(_CODE.findall(sentence)) > max(1, len(words) // 8):
        return None
    return profiles().latin(latin)


def _units(line: str) -> tuple[list[str], str | None, str]:
    """The strings of a line, its comment or bare text, and the leader if the whole line is a comment."""
    quoted, bare = [], line
    if '"' in line or "'" in line or "`" in line:
        quoted = [next((g for g in m.groups() if g is not None), "") for m in _QUOTED.finditer(line)]
        bare = _QUOTED.sub('""', line)
    strings, comment, leader = [q for q in quoted if len(q) >= MIN_DENSE], None, ""
    head = _LINE_HEAD.match(line)
    if head.group().strip():
        comment, leader = line[head.end() :], head.group().strip()
    elif t := _TRAIL.search(bare):
        # the comment in the original line: quotes inside it belong to it
        start = line.find(bare[t.start() : t.end()].strip() or bare[t.start() : t.end()])
        comment = line[start + (t.end() - t.start()) :] if start >= 0 else bare[t.end() :]
    elif not quoted:
        comment = line[head.end() :]
        leader = "" if _CODE.search(comment) else "text"  # lines of a string or comment that began above
    if not quoted and ("=" in line or ":" in line) and (v := _CONFIG_VALUE.match(line)):
        strings.append(v.group(1))
    # an opening or closing quote whose partner stands on another line
    if bare.count('"') % 2 or bare.count("`") % 2:
        strings.append(re.sub(r"\"\"", " ", bare).strip(" \"'`"))
    return strings, comment, leader


#: What a worker remembers: sentences of texts, and what lines hold; code repeats its lines. Emptied at a fixed size.
_REMEMBERED, _LONGEST = 200_000, 1_000
_known_texts: dict[str, list[tuple[str, str]]] = {}
_known_lines: dict[str, tuple[list[tuple[str, str]], str, str]] = {}


def _remember(table: dict, key: str, value):
    if len(key) <= _LONGEST:
        if len(table) >= _REMEMBERED:
            table.clear()
        table[key] = value
    return value


def _sentences(text: str) -> list[tuple[str, str]]:
    """``(language, sentence)`` of the sentences of a text."""
    got = _known_texts.get(text)
    if got is not None:
        return got
    found = [(lang, x.strip()) for x in _SENTENCE_END.split(text) if x and (lang := language(x))]
    return _remember(_known_texts, text, found)


def _parsed(line: str) -> tuple[list[tuple[str, str]], str, str]:
    """Sentences in the strings of a line, its comment without tags and escapes, and the comment's leader."""
    got = _known_lines.get(line)
    if got is not None:
        return got
    strings, comment, leader = _units(line) if line.strip() else ([], None, "")
    found = [x for text in strings for x in _sentences(unescape(_TAGS.sub(" ", text)).strip())]
    text = unescape(_TAGS.sub(" ", comment)).strip() if comment is not None else ""
    return _remember(_known_lines, line, (found, text, leader))


def _merged(lines: list[str], wanted: frozenset) -> list[tuple[str, str]]:
    """Sentences of a run of comment lines."""
    if len(lines) == 1:
        return _sentences(lines[0])
    out: list[tuple[str, str]] = []
    group: list[str] = []
    last = None

    def close() -> None:
        if len(group) == 1:
            out.extend(_sentences(group[0]))
            return
        got = _sentences(" ".join(group))
        alone = [x for line in group for x in _sentences(line)]
        # joining must lose no language: lines that end without a mark may still be sentences of their own
        out.extend(got if {lang for lang, _ in alone} & wanted <= {lang for lang, _ in got} else alone)

    for line in lines:
        tags = _sentences(line)
        whole = len(tags) == 1 and len(tags[0][1]) == len(line)
        first = tags[0][0] if tags and (whole or line.startswith(tags[0][1])) else None
        if group and (_ENDED.search(group[-1]) or (first and last and first != last)):
            close()
            group, last = [], None
        group.append(line)
        if tags and line.endswith(tags[-1][1]):
            last = tags[-1][0]
        elif not whole and tags:
            last = None
    close()
    return out


def find_texts(content: str, english: bool = False) -> list[tuple[str, str, str, int]]:
    """``(kind, language, text, times)`` of sentences in reported languages, and in English if asked for."""
    wanted = REPORTED | {"en"} if english else REPORTED
    out: dict[tuple[str, str], list] = {}

    def add(kind: str, found: list[tuple[str, str]]) -> None:
        for key in found:
            if key[0] in wanted:
                out.setdefault(key, [kind, 0])[1] += 1

    run: list[str] = []
    leader = ""
    for line in content.split("\n"):
        strings, text, own = _parsed(line)
        if strings:
            add("string", strings)
        if run and not (own and text and own[0] == leader[0]):
            add("comment", _merged(run, wanted))
            run = []
        if own and text:
            run.append(text)
            leader = own
        elif text:
            add("comment", _sentences(text))
    if run:
        add("comment", _merged(run, wanted))
    return [(kind, lang, text, n) for (lang, text), (kind, n) in out.items()]


def hidden_texts(rows: DataFrame, id_col: str = "id", text_col: str = "content", english: bool = False) -> DataFrame:
    """``(id, nl_lang, kind, text, times)``: sentences in comments and strings, English ones only if asked for.

    Null and empty texts have none; repeated rows give repeated rows; extra columns are ignored. A narrow
    map without a shuffle, over whole texts.
    """
    narrow = rows.select(id_col, text_col)
    kind_of = narrow.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, cols = [], [[], [], [], []]
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text:
                    for kind, lang, sentence, times in find_texts(text, english):
                        index.append(i)
                        for c, v in zip(cols, (lang, kind, sentence, times)):
                            c.append(v)
            ids = batch.column(0).take(pa.array(index, type=pa.int64()))
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, type=t) for c, t in zip(cols, kinds))], names=["id", "nl_lang", "kind", "text", "times"])

    return narrow.mapInArrow(run, f"id {kind_of}, nl_lang string, kind string, text string, times int")


def language_shares(rows: DataFrame) -> DataFrame:
    """``(file_path, nl_lang, sentences, chars, share)``: how much of each file's rows is text in a language.

    ``rows(id, file_path, content)``; rows without a path form the group of the null path. Every occurrence counts, and
    English counts like any other language.
    """
    sizes = rows.groupBy("file_path").agg(F.sum(F.coalesce(F.length("content"), F.lit(0))).alias("total"))
    keyed = rows.select(F.struct("id", "file_path").alias("key"), "content")
    found = hidden_texts(keyed, "key", english=True).select(F.col("id.file_path").alias("file_path"), "nl_lang", "text", "times")
    chars = F.sum(F.length("text") * F.col("times"))
    texts = found.groupBy("file_path", "nl_lang").agg(F.sum("times").alias("sentences"), chars.alias("chars"))
    paths = sizes.withColumnRenamed("file_path", "p")
    joined = texts.join(paths, texts.file_path.eqNullSafe(paths.p))
    return joined.select("file_path", "nl_lang", "sentences", "chars", (F.col("chars") / F.col("total")).alias("share"))
