"""Problem 6: natural language in code."""

import pytest

from tessel.llm import hidden_text as H

YES = [
    ("// Die Prüfsumme zählt die fehlenden Kanten sobald die Sperre frei ist", {"de"}), ('x = "Die Prfsumme zhlt die fehlenden Kanten sobald die Sperre frei ist"', {"de"}),
    ("# Aenderungen gehen beim naechsten Lauf leider ganz verloren", {"de"}), ('log("Chaque requ\\u00eate v\\u00e9rifie une copie du graphe puis \\u00e9crit une ligne")', {"fr"}),
    (" * Le processus deplace seulement les lignes modifiees au demarrage", {"fr"}), ("-- Esta función compara una copia del grafo mientras otros siguen leyendo", {"es"}),
    ('"note": "La cola interna libera los archivos mas grandes",', {"es"}), ("NOTE=O contador compara o caminho completo até a próxima inicialização", {"pt"}),
    ('fprintf(stderr, "A fila interna remove os símbolos já conhecidos");', {"pt"}), ("// Рабочий процесс удаляет состояние сеанса пока другие читают", {"ru"}),
    ('f("这个函数定期删除邻居的列表并写入一行日志")', {"zh"}), ("# 次の層は変更された行だけを順序を変えずに並べ替えます", {"ja"}), ('f("\\u4e0b\\u4e00\\u5c42\\u76f4\\u63a5\\u4e22\\u5f03\\u6700\\u5927\\u7684\\u6587\\u4ef6")', {"zh"}),
    ('"""\nDas Verzeichnis verwirft den vollständigen Pfad damit niemand warten muss.\n"""\nx = "El directorio elimina la ruta completa después de leer"', {"de", "es"}),
    ("// Der letzte Abschnitt meldet\n// das alte Schema bevor", {"de"}), ("# @param x Die Warteschlange sammelt alle alten Einträge", {"de"}),
]
NO = [
    "// The sparse edge copies the session across the edge which keeps memory flat.", 'x = "select id, name from chunks where n > 0"', "// metric_liste = flush(frame, 42)", "# siehe oben", "für = la + el + le + que + una",
    "", 'm["don\'t"] = 170', "// 缓存", "let des = le.la(el, una, les, para);", "aGVsbG8gd29ybGQ+der/die+das/und", "// Die Hard is a film", "a\x00b\x00 \x00d\x00e\x00r\x00 \x00d\x00i\x00e", 'x = "한국어 문장은 여기에 있습니다 그리고 더 있습니다"',
    'y = "Het systeem verwijdert nooit een rij terwijl een ander proces die nog leest"',
]


@pytest.mark.parametrize("text,langs", YES)
def test_found(text, langs):
    assert {lang for _, lang, *_ in H.find_texts(text)} == langs


@pytest.mark.parametrize("text", NO)
def test_no_case(text):
    assert H.find_texts(text) == []


def test_escapes():
    assert H.unescape("gr\\u00f6\\u00dfte \\xc3\\xa9 \\xe9 &auml; \\ud83e\\udde9 \\\"x\\\"") == 'größte é é ä 🧩 "x"'


def test_table(spark):
    rows = [(1, "a.py", YES[0][0]), (2, None, YES[5][0]), (3, "a.py", None), (4, "b.py", ""), (1, "a.py", YES[0][0]), (5, "c.js", "x" * 1_500_000 + "\n" + YES[9][0])]
    df = spark.createDataFrame([(*r, "t") for r in rows], "id bigint, file_path string, content string, text string")
    got = sorted((r.id, r.nl_lang) for r in H.hidden_texts(df).select("id", "nl_lang").distinct().collect())
    assert got == [(1, "de"), (2, "es"), (5, "ru")]
    shares = {(r.file_path, r.nl_lang): r for r in H.language_shares(df).collect()}
    assert set(shares) == {("a.py", "de"), (None, "es"), ("c.js", "ru")} and shares["a.py", "de"].sentences == 2 and 0.9 < shares["a.py", "de"].share <= 1
    assert H.hidden_texts(df.limit(0)).count() == 0


def test_held_out_sentences():
    held = {
        "de": ["Wir löschen alte Dateien erst wenn niemand sie mehr braucht", "Bei großen Mengen wird der Vorgang in mehrere Teile zerlegt", "Ohne gültigen Schlüssel wird die Anfrage sofort abgelehnt"],
        "fr": ["Nous supprimons les anciens fichiers quand personne ne les utilise", "Cette valeur est lue une seule fois au lancement du programme", "Sans clé valide la demande est refusée tout de suite"],
        "es": ["Borramos los ficheros viejos cuando ya nadie los necesita", "Este valor se lee una sola vez al iniciar el programa", "Sin una clave válida se rechaza la petición de inmediato"],
        "pt": ["Apagamos os ficheiros velhos quando já ninguém precisa deles", "Este valor é lido uma única vez no início do programa", "Sem uma chave válida o pedido é rejeitado de imediato"],
    }
    for lang, sentences in held.items():
        for s in sentences:
            assert H.language(s) == lang, s
            assert H.language(H.fold(s)) == lang, s


BARE = [
    "// A tabela de projetos substitui o caminho completo em vez de abortar o lote", 'log("O grafo de chamadas ignora o estado da sessao em vez de abortar o lote")',
    "# O contador libera os arquivos\n# maiores em vez de abortar o lote",
]


@pytest.mark.parametrize("text", BARE)
def test_sentences_without_marks_are_classified(text):
    assert {lang for _, lang, *_ in H.find_texts(text)} == {"pt"}


@pytest.mark.parametrize("text", [
    "// return nil if schema.nil?", "# Imports: logging, os, json, sensor", "# Compact label margin schema: schema", "from core.schema import Weight",
    "# Functions: routeDeltaSession, sampleQuota, enqueueSegmentDelta, enqueueTenantParcel",
])
def test_code_without_marks_is_no_case(text):
    assert H.find_texts(text) == []


LONG = """// Der Indexlauf prüft zuerst den Zustand aller alten
// Einträge in der Tabelle und löscht danach jeden
// Abschnitt den kein anderer Prozess mehr liest bevor
// der nächste Lauf beginnt und die Sperre wieder
// frei ist. The next run starts after all of them are written.
// Keep the order of entries in this table as it is now"""


def test_a_run_of_comment_lines_is_one_text():
    got = H.find_texts(LONG, english=True)
    assert [(lang, kind) for kind, lang, *_ in got] == [("de", "comment"), ("en", "comment"), ("en", "comment")]
    assert got[0][2].startswith("Der Indexlauf") and got[0][2].endswith("frei ist.") and got[1][2].startswith("The next run")
    assert [x[1] for x in H.find_texts(LONG)] == ["de"]
    mixed = "# Fehler treten gelegentlich trotz Wiederholung weiterhin unbemerkt auf\n# Every request is checked before the result gets stored"
    assert [x[1] for x in H.find_texts(mixed, english=True)] == ["de", "en"]


def test_occurrences_are_counted():
    text = YES[0][0]
    assert [(lang, n) for _, lang, _, n in H.find_texts(f"{text}\nx = 1\n{text}")] == [("de", 2)]


def test_shares_count_english(spark):
    rows = [(1, "a.py", f"{YES[0][0]}\nrun()\n{YES[0][0]}\nrun()\n// The next run starts after all files have been written.")]
    shares = {r.nl_lang: r for r in H.language_shares(spark.createDataFrame(rows, "id bigint, file_path string, content string")).collect()}
    assert shares["de"].sentences == 2 and shares["en"].sentences == 1 and 0.8 < shares["de"].share + shares["en"].share < 1
