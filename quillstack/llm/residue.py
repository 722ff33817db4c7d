"""Problem 8: template residue, filler, error pages and script notices where content should be.

One multi-pattern automaton holds stock phrases in four languages, the keys of notices in any wording, and the
literals with which placeholders, filler Latin, traces and error pages begin. It says where to look: a phrase counts
as a sentence of its own, a key if nearly all words of its sentence are parts of notices, a literal if the whole form
stands there. What stands in a code fence, backticks or quotation marks is masked, and who tells of residue is no case.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..plans.scratch import table

#: Sentences that stand where content should be, lower case, without the stop at their end. Fixed values.
FILLER = """
your text here|your text goes here|your content goes here|your content here|add your text here|add your transcript here
add your content here|insert your text here|insert text here|insert description here|insert content here|enter your text here
type your text here|write your text here|click to edit this text|click here to edit|edit this text|replace this text
replace this block before publishing|replace this text before publishing|sample text, replace me|sample text|dummy text|placeholder text
placeholder copy for this section|this is a placeholder|this is placeholder text|this is sample text|this is dummy text
this paragraph is only here to fill the page|this text is only here to fill the page|content coming soon|coming soon|content to follow
description to follow|text to follow|description coming soon|transcript coming soon|no description yet|test transcript, please ignore
test post, please ignore|this is a test, please ignore|test page, please ignore|default description|content goes here
contenu à venir|texte à venir|description à venir|texte à remplacer|insérez votre texte ici|votre texte ici|ajoutez votre texte ici
saisissez votre texte ici|ceci est un texte de remplissage|texte de remplissage|exemple de texte|texte d'exemple pour cette section
texte provisoire|bientôt disponible|blindtext für diesen abschnitt|dies ist ein blindtext|blindtext|platzhaltertext|hier steht ihr text
hier steht dein text|ihr text hier|hier text einfügen|fügen sie hier ihren text ein|text folgt|inhalt folgt|inhalt folgt in kürze
beschreibung folgt|beispieltext für diesen abschnitt|dies ist ein platzhalter|contenido próximamente|próximamente|texto de ejemplo
texto de ejemplo para esta sección|texto de relleno|escriba aquí su texto|escribe aquí tu texto|inserte aquí su texto|su texto aquí
inserte su texto aquí|descripción próximamente|texto provisional|este es un texto de relleno|contenido en preparación
"""
#: Messages of error pages and failed programs, in the same form. Fixed values.
ERRORS = """
something went wrong|something went wrong, please try again later|oops, something went wrong|oops! something went wrong|an error occurred
an error has occurred|an unexpected error occurred|an unexpected error has occurred
an unexpected error occurred while processing your request|an error occurred while processing your request|page not found|file not found
the page you requested could not be found|the requested page could not be found|the page you are looking for could not be found
the page you are looking for does not exist|this page does not exist|the requested url was not found on this server
the link may be broken or expired|this page isn't working|this page is not working|this site can't be reached|access denied
permission denied|you do not have permission to open this resource|you do not have permission to view this page
you do not have permission to access this resource|you don't have permission to access this resource|your session has expired
your session has expired, sign in again to continue|your session has expired, please log in again|too many requests
too many requests from your network|slow down and retry|the server did not answer in time|the server took too long to respond
the upstream host sent an invalid answer|the server encountered an internal error|the connection was reset before the page could load
the connection was reset|the connection has timed out|we could not load this transcript|this transcript could not be loaded
this video is no longer available|this video is unavailable|this video is private|video unavailable|this content is no longer available
captions are not available for this video|transcript is not available for this video|no transcript available
we are down for maintenance and will be back shortly|we are down for maintenance|the site is down for maintenance|down for maintenance
something broke on our side, the team has been told|something broke on our side|service temporarily unavailable|service unavailable
the service is temporarily unavailable|internal server error|bad gateway|gateway timeout|request timeout|try again later
please try again later|segmentation fault (core dumped)|segmentation fault
la page demandée est introuvable|la page demandée n'existe pas|page introuvable|page non trouvée|accès refusé|accès interdit
vous n'avez pas accès à cette page|le service est momentanément indisponible|service indisponible|le service est indisponible
une erreur est survenue|une erreur est survenue, veuillez réessayer plus tard|une erreur s'est produite|veuillez réessayer plus tard
cette vidéo n'est plus disponible|cette vidéo n'est pas disponible|votre session a expiré|erreur interne du serveur|site en maintenance
die angeforderte seite wurde nicht gefunden|seite nicht gefunden|die seite wurde nicht gefunden|zugriff verweigert
der dienst ist zurzeit nicht erreichbar|der dienst ist derzeit nicht verfügbar|es ist ein fehler aufgetreten|ein fehler ist aufgetreten
es ist ein fehler aufgetreten, bitte später erneut versuchen|bitte versuchen sie es später erneut|bitte später erneut versuchen
dieses video ist nicht mehr verfügbar|dieses video ist nicht verfügbar|ihre sitzung ist abgelaufen|interner serverfehler
keine berechtigung für diese seite|no se encontró la página solicitada|página no encontrada|la página solicitada no existe
acceso denegado|no tiene permiso para ver esta página|el servicio no está disponible en este momento|servicio no disponible
se produjo un error|se produjo un error, vuelva a intentarlo más tarde|se ha producido un error|vuelva a intentarlo más tarde
inténtelo de nuevo más tarde|este vídeo ya no está disponible|este video ya no está disponible|este vídeo no está disponible
su sesión ha caducado|su sesión ha expirado|error interno del servidor
"""
#: Notices that scripts must be on; * stands for each of SCRIPT_WORDS. These are heads: a sentence may go on after them.
SCRIPTS = """
please enable *|please activate *|please turn on *|please allow *|you need to enable *|you need to activate *|you need to turn on *
you need to allow *|you must enable *|you have to enable *|enable * to|activate * to|turn on * to|allow * to|* is disabled
* is not enabled|* is turned off|* is switched off|* is off in your browser|* is required|* required|* must be on|* must be enabled
* must be turned on|your browser has * switched off|your browser has * disabled|your browser has * turned off
your browser does not support *|your browser doesn't support *|it looks like * is disabled|looks like * is disabled
this site requires *|this page requires *|this app requires *|this website requires *|this player requires *|this site needs *
this page needs *|if you can read this, * did not run|we're sorry but this player doesn't work properly without *
we're sorry but this app doesn't work properly without *|we're sorry but this site doesn't work properly without *
we're sorry but this page doesn't work properly without *|this site doesn't work without *|this page doesn't work without *
veuillez activer *|activez *|merci d'activer *|ce site nécessite *|cette page nécessite *|* est désactivé|* est requis|* doit être activé
votre navigateur ne prend pas en charge *|vous devez activer *|bitte aktivieren sie *|bitte aktiviere *|aktivieren sie *
diese seite benötigt *|diese website benötigt *|* ist in ihrem browser ausgeschaltet|* ist deaktiviert|* ist erforderlich
* ist ausgeschaltet|* muss aktiviert sein|active * para|active * en|habilite *|por favor, active *|por favor active *
por favor, habilite *|debe activar *|este sitio necesita *|esta página necesita *|este sitio requiere *|esta página requiere *
* está desactivado|* está deshabilitado|se requiere *|es necesario activar *
"""
SCRIPT_WORDS = ("javascript", "scripts", "scripting", "los scripts", "les scripts", "skripte")
#: Words of the filler Latin. Fixed values.
LATIN = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim
veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit
esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum
""".split()
#: Last words of what a placeholder asks for, where its brackets alone don't tell it from other text.
FIELD_WORDS = """
name title date number topic speaker sponsor summary duration text description author email address phone url link image company
product city country price time place host guest channel episode chapter video keyword category tag subject signature here
""".split()
#: Reason phrases that follow a status code, and the words of error pages' titles. Fixed values.
REASONS = """
bad request|unauthorized|payment required|forbidden|not found|method not allowed|not acceptable|request timeout|conflict|gone
payload too large|too many requests|internal server error|not implemented|bad gateway|service unavailable|gateway timeout
error|sorry|oops|fehler|entschuldigung|erreur|désolé|error del servidor|lo sentimos|this page isn't working|page not found
seite nicht gefunden|page introuvable|página no encontrada|something went wrong
"""

#: A fence begins a line and has no other on it; where it ends, plain() puts \x03. One that isn't closed ends before a blank line or a heading.
_FENCE = re.compile(r"^[^\S\n]*(```|~~~)((?:(?!\1)[^\n])*)$", re.M)
_UNCLOSED = re.compile(r"\n[^\S\n]*(?=\n)|\n(?=[^\S\n]*#{1,6}[^\S\n])")
_FENCED = r"(```|~~~)[^\n]*?\1|^ ?(?:```|~~~).*?(?:\x03|\Z)"
_IN_FENCE = re.compile(_FENCED, re.M | re.S)
_QUOTED = re.compile(_FENCED + r"|`[^`\n]*`|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|\"[^\"\n]*\"", re.M | re.S)
_ERROR_JSON = re.compile(r"\{\s*\"(?:error|errors|fault)\"\s*:\s*[\[{]?\s*\{?\s*\"(?:code|status|message|type)\"[^\n]*")
_FIELD = r"(?:[a-zà-ÿ]+[ _-]){0,4}(?:" + "|".join(FIELD_WORDS) + r")"
#: Literal with which such a placeholder begins (in lower case, for the automaton), and its form, which goes on to the closing bracket in the line.
_PLACEHOLDERS = [
    ("{{", r"\{\{[^{}\n]+\}\}"),
    ("[[", r"\[\[[a-z][\w .-]+\]\]"),
    ("<<", r"<<[a-z][\w .-]+>>"),
    ("<%", r"<%[^%\n]+%>"),
    ("${", r"\$\{[a-z_][\w.-]*\}"),
    ("$", r"\$[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*\$"),
    ("%%", r"%%[a-zA-Z]\w+%%"),
    ("@@", r"@@[a-zA-Z]\w+@@"),
    ("%(", r"%\(\w+\)[sdif]"),
    ("%s", r"(?<![\w%])%s(?!\w)"),
    ("{", r"(?<![\w{$#\"'])\{(?:\d|[a-zA-Z]\w+)\}(?!\})"),
    ("__", r"(?<!\w)__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__(?!\w)|(?<=[^\s_] )_{5,}(?![\w])|(?<![\w])_{5,}(?= ?[^\s_])"),
    ("#", r"(?<![\w#&/])#[a-z]+(?:_[a-z]+)*#(?!\w)"),
    ("<", rf"<(?:[Ii]nsert|INSERT|[Yy]our|YOUR) [\w .-]+>|<(?:[a-z]+_)+[a-z]+>|<(?:[a-z]+ )+(?:{'|'.join(FIELD_WORDS)})>"),
    ("\x01", rf"\x01(?:[Ii]nsert [\w .-]+|{_FIELD})\x02"),
    ("[", rf"\[(?:[Ii]nsert|INSERT|[Yy]our|YOUR|[Aa]dd|ADD)\b[^\[\]\n]+\](?!\()|\[[Tt]o be (?:filled|added|written|completed|confirmed|determined)[^\[\]\n]*\]|\[{_FIELD}\](?!\()"),
    ("todo", r"\b(?:TODO|FIXME): ?(?:add|write|insert|fill|replace|update|complete)\b[^\n]{0,30}"),
    ("fixme", r"\b(?:TODO|FIXME): ?(?:add|write|insert|fill|replace|update|complete)\b[^\n]{0,30}"),
]
_FORMS = [re.compile(form) for _, form in _PLACEHOLDERS]
#: Forms that begin before the literal they have: found in its line.
_LINE_FORMS = [
    *[(x, "placeholder", re.compile(r"\([^()\n]*\bTB[DCA]\)|\[[^\[\]\n]*\bTB[DCA]\]")) for x in ("tbd)", "tbc)", "tba)", "tbd]", "tbc]", "tba]")],
    ("??", "placeholder", re.compile(r"\b[A-ZÀ-Þ][\w-]*(?: [A-Z][\w-]*){0,4}: ?\?{3,}")),
]
_TRACE = re.compile(r"^(?:traceback \(most recent call last\):|exception in thread \"?\S+|fatal error: |unhandled exception|panic: |uncaught (?:type|reference|syntax|range)?error\b)", re.M)
_STATUS = re.compile(r"(?:^|(?<=[>.!?|] )|(?<=>))(?:http |error |fehler |erreur )?(?:error )?[45]\d\d\b[ .:–—-]*(?:" + "|".join(sorted((re.escape(x) for x in REASONS.replace("\n", "|").split("|") if x), key=len, reverse=True)) + r")(?=\s*(?:$|[.:!<(–—-]))", re.M)
_HTML_PAGE = re.compile(r"<title>(?:[^<\n]{0,20}\b[45]\d\d\b[^<\n]{0,40}|(?:" + "|".join(re.escape(x) for x in REASONS.replace("\n", "|").split("|") if x) + r"))</title>")
_LATIN = re.compile(r"(?<![\w])(?:(?:" + "|".join(sorted(set(LATIN), key=len, reverse=True)) + r")[\s.,]+){5,}")
_BLANK = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")
_STARTS = set("\n.!?:;|>)(–—-*#…\x00\x02\"“„«")
_ENDS = set("\n.!?:;|<(),–—-…\x00")
#: Where a sentence ends for the parts, and its words.
_CUT = re.compile(r"[\n.!?:;|<>()\[\]{}–—…\x00-\x03\"“”„«»]")
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
_LOG_LINE = re.compile(r"\d\d:\d\d|\b(?:info|warn|warning|error|debug|trace|fatal)\b[\s\]:]")

#: Parts of which notices are made. A sentence is residue if it has a key and one of the key's things, nearly all its words are parts, and it has no word
#: of a person who tells something.
KEYS = {
    "script": """
disabled|enable|enabled|activate|activated|turn on|turned on|turn * on|switch on|switched on|switch * on|turned off|switched off|blocked|blocking|blocks
required|requires|require|need|needs|needed|necessary|allow|must be on|must be|without|does not support|doesn't support|not supported|not running|did not run
aktivieren|aktiviert|deaktiviert|einschalten|eingeschaltet|ausgeschaltet|blockiert|benötigt|benötigen|erforderlich|notwendig|zulassen|erlauben|ohne
activer|activez|activé|désactivé|bloqué|nécessaire|nécessite|requis|requiert|autoriser|autorisez|sans|obligatoire
activar|active|activado|desactivado|deshabilitado|habilitar|habilite|habilitado|bloqueado|necesario|necesita|requiere|requerido|permitir|permita|sin|obligatorio
""",
    "error": """
went wrong|gone wrong|hit a snag|hit a problem|ran into a problem|ran into an error|could not|couldn't|cannot|can't|can not|unable to|failed to|not found|doesn't exist
does not exist|no longer exists|no longer available|not available|unavailable|expired|denied|forbidden|not authorized|not authorised|unauthorized|not allowed
not permitted|no permission|timed out|overloaded|been moved|been removed|been deleted|having trouble|having problems|having difficulties|trouble loading|not responding
under maintenance|for maintenance|not reachable|unreachable|an error|a problem occurred|crashed|try again
schiefgelaufen|schiefgegangen|nicht geladen|nicht gefunden|nicht verfügbar|nicht mehr verfügbar|nicht erreichbar|nicht berechtigt|nicht erlaubt|nicht gestattet
nicht möglich|existiert nicht|abgelaufen|verweigert|fehlgeschlagen|ein fehler|überlastet|wartungsarbeiten|nicht angezeigt|keine berechtigung|verschoben oder gelöscht
impossible de|introuvable|n'existe pas|n'existe plus|pas disponible|plus disponible|indisponible|expiré|refusé|interdit|pas autorisé|une erreur|échoué|en maintenance
pas pu être|n'a pas pu|surchargé|mal passé|déplacée ou supprimée
salió mal|ido mal|no se pudo|no se puede|no se ha podido|no encontrada|no encontrado|no existe|no está disponible|ya no está disponible|no disponible|caducado|expirado
denegado|prohibido|no autorizado|no tiene permiso|no está autorizado|un error|ha fallado|fallido|en mantenimiento|sobrecargado|fue eliminada|ha sido eliminada
""",
    "filler": """
coming soon|goes here|go here|goes in|to be written|to be added|to be completed|to be announced|been written|written yet|be added|be available soon|be updated|be completed
placeholder|dummy|replace me|replace this|under construction|to follow|added soon|follows soon|yet to come|fill in|fill this in|not yet available|insert
wird noch|folgt in kürze|folgt bald|folgt noch|kommt noch|in bearbeitung|noch nicht|in arbeit|in vorbereitung|demnächst|platzhalter|im aufbau
à compléter|à venir|à remplir|à rédiger|sera complétée|sera complété|sera ajoutée|sera ajouté|sera disponible|sera bientôt|bientôt|prochainement|en construction|en préparation
pendiente|próximamente|en construcción|en preparación|estará disponible|se añadirá|será añadido|por completar|por escribir|pronto
""",
}
THINGS = {
    "script": "javascript|js|scripts|scripting|skripte|los scripts|les scripts",
    "error": """
page|site|website|app|application|content|contents|video|transcript|resource|document|link|url|server|service|request|session|file|connection|captions|something
seite|webseite|website|inhalt|inhalte|dokument|anfrage|sitzung|dienst|verbindung|datei|untertitel|transkript|etwas
contenu|site|vidéo|document|requête|serveur|session|lien|fichier|connexion|transcription|quelque chose
página|sitio|contenido|vídeo|documento|solicitud|servidor|servicio|sesión|enlace|archivo|conexión|transcripción|algo
""",
    "filler": """
text|content|section|description|page|information|details|title|summary|copy|abstract|chapter|transcript|article
abschnitt|inhalt|inhalte|beschreibung|zusammenfassung|kapitel|seite|titel|texte
texte|contenu|section|paragraphe|résumé|chapitre|titre|page
texto|contenido|sección|descripción|resumen|capítulo|título|página|información
""",
}
PARTS = """
this|that|the|a|an|your|our|you|it|is|are|be|been|has|have|to|in|on|of|for|and|or|at|with|from|please|sorry|oops|whoops|uh oh|error|currently|right now|now|again|later|moment
shortly|soon|few|minutes|minute|seconds|try|retry|reload|refresh|back|home|check|continue|view|see|use|open|access|display|load|loading|loaded|find|found|show|shown|run|work
works|properly|correctly|any|longer|more|all|we're|we are|we|were looking for|are looking for|requested|completed|processed|reached|connect|connecting|browser|settings|seems
appears|looks like|seem|appear|not|will|here|yet|temporarily|because|while|real|actual|own|full|will be|must|should|may|can|features|feature|space|place|area|text|off
die|der|das|diese|dieser|dieses|diesem|dieser seite|ein|eine|einen|ihr|ihre|ihren|ihrem|sie|in|im|für|um|zu|ist|sind|wird|wurde|werden|konnte|kann|können|muss|müssen|sein
bitte|leider|nicht|noch|hier|hin|text|browser|anzuzeigen|anzeigen|öffnen|laden|geladen|ergänzt|hinzugefügt|später|erneut|versuchen|und|oder|mehr|mit|zurzeit|derzeit|momentan
ce|cet|cette|ces|le|la|les|un|une|des|du|de|d'|votre|vos|vous|nous|pour|dans|sur|est|sont|être|a été|a|ne|n'est|pas|plus|veuillez|merci d'|merci de|désolé|oups|ou|et|demandée
demandé|recherchée|que|cherchez|afficher|voir|charger|ouvrir|continuer|réessayer|réessayez|tard|navigateur|ici|complétée|complété|accéder|page|s'est|actuellement|momentanément
este|esta|esto|el|la|los|las|un|una|su|sus|de|del|para|por|en|es|está|estará|ha|se|que|busca|no|ya|favor|lo sentimos|o|y|ver|cargar|abrir|mostrar|continuar|acceder|inténtelo
intente|nuevo|más|tarde|navegador|aquí|solicitada|solicitado|disponible|momento|debe|mal|cargarse|puede|pudo
"""
#: Who tells of residue is no residue. Past tenses that notices don't have, persons other than we and you, and names of what is spoken of.
TELLING = set("""
i i'm i've i'd my me he she his her him they them their us had was were said says told asked ask asks why message messages notice notices explains means
ich er mir mich mein meine war hatte sagte fragte warum meldung hinweis je j'ai mon ma il elle ils elles était avait pourquoi yo mi él ella ellos era había dijo porque mensaje
""".split())
#: Words of a sentence that have to be parts, and words it may have at most.
PART_SHARE, MOST_WORDS = 0.9, 24
#: What sends the automaton to look at a place closely.
_LATIN_HEADS = ("lorem", "dolor", "consequat", "ullamco", "nostrud")
_TRACES = ("traceback (most recent call last):", "exception in thread", "fatal error: ", "unhandled exception", "panic: ", "uncaught ")
_JSON_HEADS = ('"error"', '"errors"', '"fault"')


def _split(text: str) -> list[str]:
    return [x for x in text.replace("\n", "|").split("|") if x]


@lru_cache(1)
def _automaton():
    """All phrases, keys and literals; of each what it stands for: (kind, length, detail) several times."""
    import ahocorasick

    own: dict[str, list[tuple]] = {}

    def put(word: str, kind: str, detail: object = None) -> None:
        own.setdefault(word, []).append((kind, len(word), detail))

    for kind, phrases in (("filler", FILLER), ("error", ERRORS)):
        for phrase in _split(phrases):
            put(phrase, "phrase", (kind, True))
    for frame in _split(SCRIPTS):
        for word in SCRIPT_WORDS:
            put(frame.replace("*", word), "phrase", ("script", False))
    for k, (literal, _) in enumerate(_PLACEHOLDERS):
        put(literal, "form", k)
    for k, (literal, *_) in enumerate(_LINE_FORMS):
        put(literal, "line", k)
    for kind in ("error", "filler"):
        for key in _split(KEYS[kind]):
            put(key, "key", kind)
    for thing in _split(THINGS["script"]):
        put(thing, "key", "script")
    for x in _LATIN_HEADS:
        put(x, "latin")
    for x in _TRACES:
        put(x, "trace")
    for x in _split(REASONS):
        put(x, "status")
    put("<title>", "title")
    for x in _JSON_HEADS:
        put(x, "json")
    made = ahocorasick.Automaton()
    for word, what in own.items():
        made.add_word(word, what)
    made.make_automaton()
    return made


@lru_cache(1)
def _parts():
    """The parts as words between blanks, and what they are."""
    import ahocorasick

    own: dict[str, set[tuple[str, str]]] = {}
    for role, lists in (("key", KEYS), ("thing", THINGS)):
        for kind, text in lists.items():
            for x in _split(text):
                own.setdefault(x, set()).add((role, kind))
    for x in _split(PARTS):
        own.setdefault(x, set()).add(("part", ""))
    for x, what in list(own.items()):
        if "*" in x:  # a key around its thing
            del own[x]
            for thing in _split(THINGS["script"]):
                own.setdefault(x.replace("*", thing), set()).update(what | {("thing", "script")})
    made = ahocorasick.Automaton()
    for x, what in own.items():
        made.add_word(f" {x} ", (len(x), frozenset(what)))
    made.make_automaton()
    return made


@lru_cache(4096)
def _made_of_parts(sentence: str) -> frozenset[str]:
    """The kinds of residue that a sentence is by its parts."""
    words = _WORD.findall(sentence)
    if not 2 <= len(words) <= MOST_WORDS or not TELLING.isdisjoint(words):
        return frozenset()
    plain_ = f" {' '.join(words)} "
    hit = bytearray(len(plain_))
    found: set[tuple[str, str]] = set()
    for last, (size, what) in _parts().iter(plain_):
        hit[last - size : last] = b"\x01" * size
        found |= what
    at, n = 1, 0
    for w in words:
        n += all(hit[at : at + len(w)])
        at += len(w) + 1
    if n < PART_SHARE * len(words):
        return frozenset()
    return frozenset(k for k in KEYS if ("key", k) in found and ("thing", k) in found)


def _ended(text: str) -> str:
    """The text with \\x03 where its fences end."""
    marks = list(_FENCE.finditer(text))
    ends, k = [], 0
    while k < len(marks):
        after = next((j for j in range(k + 1, len(marks)) if marks[j][1] == marks[k][1]), None)
        if after is not None and not marks[after][2].strip("`~ \t\r"):
            ends.append(marks[after].end())
            k = after + 1
            continue
        stop = _UNCLOSED.search(text, marks[k].end())
        until = min(stop.start() if stop else len(text), marks[k + 1].start() - 1 if k + 1 < len(marks) else len(text))
        ends.append(until)
        k += 1
    cuts = [0, *ends, len(text)]
    return "\x03".join(text[a:b].replace("\x03", " ") for a, b in zip(cuts, cuts[1:]))


def plain(text: str) -> str:
    """The text with entities decoded, blank runs as one space or line feed, and \\x03 where fences end.

    Decoded angle brackets become \\x01 and \\x02, so that they aren't taken for tags.
    """
    if "&" in text:
        text = html.unescape(re.sub(r"&(?:lt|#60|#x3c);", "\x01", text, flags=re.I).replace("&gt;", "\x02").replace("&#62;", "\x02"))
    if "```" in text or "~~~" in text:
        text = _ended(text)
    return _LINES.sub("\n", _BLANK.sub(" ", text.replace("’", "'")))


def residue_of(text: str | None) -> list[tuple[int, int, str]]:
    """Start, end and kind (placeholder, filler, error, script) of all residue in ``plain(text)``, in order.

    One pass of the automaton says where to look; what it names is found whole at that place, in its line or in its sentence.
    """
    if not text:
        return []
    text = plain(text)
    plain_text, whole = text, _lowered(text)
    hits = list(_automaton().iter(whole))
    if not hits:
        return []
    if "`" in text or '"' in text or "“" in text or "„" in text or "«" in text or "~~~" in text:
        text = _QUOTED.sub(lambda m: "\x00" * len(m.group()), text)
    low = _lowered(text)
    found: list[tuple[int, int, str]] = []
    seen: set[tuple[str, object]] = set()  # forms and lines looked at, so that each is looked at once
    cuts: list[int] | None = None
    for last, what in hits:
        for kind, size, detail in what:
            first, end = last + 1 - size, last + 1
            if kind == "json":
                if ("json", 0) not in seen:
                    seen.add(("json", 0))
                    found += [(m.start(), m.end(), "error") for m in _ERROR_JSON.finditer(plain_text) if not _inside(plain_text, m.start())]
                continue
            if low[first] == "\x00" or low[last] == "\x00":
                continue
            if kind == "form":
                m = _FORMS[detail].match(text, first)
                if m:
                    found.append((m.start(), m.end(), "placeholder"))
            elif kind == "line":
                a, b = _line(low, first)
                if (detail, a) not in seen:
                    seen.add((detail, a))
                    found += [(m.start(), m.end(), _LINE_FORMS[detail][1]) for m in _LINE_FORMS[detail][2].finditer(text, a, b)]
            elif kind == "latin":
                if ("latin", 0) not in seen:
                    seen.add(("latin", 0))
                    found += [(m.start(), m.end(), "filler") for m in _LATIN.finditer(low)]
            elif kind in ("trace", "status", "title"):
                a, b = _line(low, first)
                if (kind, a) not in seen:
                    seen.add((kind, a))
                    found += [(a + m.start(), a + m.end(), "error") for m in {"trace": _TRACE, "status": _STATUS, "title": _HTML_PAGE}[kind].finditer(low[a:b])]
            elif kind == "phrase" and _alone(low, first, end, detail[1]):
                found.append((first, end, detail[0]))
            elif kind == "key":
                if cuts is None:
                    cuts = [-1, *(m.start() for m in _CUT.finditer(low)), len(low)]
                k = bisect_left(cuts, first)
                a, b = cuts[k - 1] + 1, cuts[k]
                if ("part", a) not in seen:
                    seen.add(("part", a))
                    if b - a <= 16 * MOST_WORDS and (kinds := _made_of_parts(low[a:b])) and not _LOG_LINE.search(low, *_line(low, a)):
                        found += [(a, b, x) for x in sorted(kinds)]
    return sorted(found)


def _lowered(text: str) -> str:
    low = text.lower()
    # a few letters grow when lowered
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _line(text: str, at: int) -> tuple[int, int]:
    end = text.find("\n", at)
    return text.rfind("\n", 0, at) + 1, len(text) if end < 0 else end


def _alone(low: str, first: int, end: int, whole: bool) -> bool:
    """Whether a phrase begins as a sentence and, if ``whole``, ends as one."""
    before, after = low[max(0, first - 2) : first], low[end : end + 2]
    if before.rstrip(" ")[-1:] not in _STARTS and before.strip():
        return False
    if before and before[-1].isalnum() or after and after[0].isalnum():
        return False
    return not (whole and after.strip(" ") and after.lstrip(" ")[0] not in _ENDS)


def _inside(text: str, at: int) -> bool:
    """Whether a place lies in a code fence or backticks."""
    head = text[:at]
    return any(m.start() <= at < m.end() for m in _IN_FENCE.finditer(text) if m[0].lstrip()[0] == "`") or head[head.rfind("\n") + 1 :].replace("```", "").count("`") % 2 == 1


def covered(found: list[tuple[int, int, str]]) -> int:
    """Characters that lie in some residue."""
    out = end = 0
    for a, b, _ in found:
        out += max(0, b - max(a, end))
        end = max(end, b)
    return out


def coverage(text: str | None, found: list[tuple[int, int, str]]) -> float:
    """Share of ``plain(text)`` that lies in what was found in it."""
    return covered(found) / len(plain(text)) if found else 0.0


def residue(documents: DataFrame) -> DataFrame:
    """doc_id, n_found, kinds (sorted), covered (characters) and coverage (share of the text as decoded) of each row.

    A narrow pass over whole texts. Null, empty and blank texts have none; rows are kept as they come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [residue_of(t) for t in texts]
            cover = [covered(f) for f in found]
            share = [coverage(t, f) for t, f in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, found), pa.int64()), pa.array([sorted({k for *_, k in f}) for f in found], pa.list_(pa.string())), pa.array(cover, pa.int64()), pa.array(share, pa.float64())], ["doc_id", "n_found", "kinds", "covered", "coverage"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_found long, kinds array<string>, covered long, coverage double")


def cleaned(documents: DataFrame, least_coverage: float = 0.0) -> DataFrame:
    """doc_id and text of the documents without residue, those with less than ``least_coverage`` of their text among them.

    By default one case is enough to exclude a document. The text goes through the same pass, so nothing is joined.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for text in batch.column(1).to_pylist():
                found = residue_of(text)
                keep.append(not found or coverage(text, found) < least_coverage)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, text string")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue(table(spark, folder, "documents", "doc_id", "text")).where("n_found > 0").select("doc_id")


def p8_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The documents without residue."""
    return cleaned(table(spark, folder, "documents", "doc_id", "text"))


def p8_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Of each document with residue, its kinds and how much of the text they cover."""
    return residue(table(spark, folder, "documents", "doc_id", "text")).where("n_found > 0")


QUERIES = {"p8_found": p8_found, "p8_kept": p8_kept, "p8_coverage": p8_coverage}
SQL: dict[str, str] = {}
