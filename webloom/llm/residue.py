"""Template residue and error pages: what is left of a page once its frame is taken off.

Normalised lines are counted by host and the recurrent frame is subtracted (frames.py).
A record is excluded when its title or residual holds an unfilled placeholder, or when
most of the residual is filler, an error message or a notice that scripts are needed.

Placeholders are a grammar of delimiters around a name. Notices are sentences in which a
thing that a server, a browser or a layout speaks of (page, request, connection, script,
text) stands near a state it may be in (not found, refused, needed, goes here), by word
families of the six languages. With these as seeds, further notices are learned: residual
lines that pages without a body share over several hosts and that mostly stand beside a
seed (learned_lines).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unfilled placeholders. Code in backticks or quotes is a mention, not a placeholder.
_QUOTED = re.compile(r"`[^`\n]{1,120}`|«[^»\n]{1,80}»|“[^”\n]{1,80}”|\"[^\"\n]{1,80}\"|„[^“”\n]{1,80}[“”]")
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]{0,60}\}\}|<%[=-]?[^%\n]{0,60}%>|\{%[^%\n]{0,60}%\}|\$\{[\w .]{1,40}\}|\$\([\w .]{1,40}\)|\[\[[\w .]{1,40}\]\]|%%\w{2,40}%%|@@[\w.]{2,60}@@"
    r"|__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+__|(?<![\w`$\\{])\{[A-Za-z_][\w.]{1,40}\}(?!\})|\[object Object\]|\bundefined undefined\b"
    r"|\*\|[A-Z0-9_:]{2,40}\|\*|(?<![\w%])%[A-Z][A-Z0-9_]{2,40}%(?!\w)|\[%[^%\n]{0,60}%\]|<\?(?:=|php\b)?[^?\n]{0,80}\?>|<<[A-Za-z][\w .-]{1,40}>>|#\{[\w .]{1,40}\}|\{\$[\w.]{1,40}\}|(?<![\w\])\\$}{])\{\d{1,2}\}(?!\})"
    r"|\[[A-Z]{2,}(?:_[A-Z0-9]+)+\]|##[A-Z][\w]{1,40}##"
    r"|\[(?:insert|your|hier|ihr|insér\w*|votre|insert\w+|su|inserir|insira|seu|вставьте|ваш\w*)\b[^\]\n]{0,40}\]",
    re.IGNORECASE,
)

#: Word families of notices, on lower-case sentences.
_ERROR = (
    r"\b(?:page|seite|página|pagina|страниц\w*|adresse|address|document)\b.{0,40}\b(?:not found|introuvable|nicht gefunden|no encontrada|não encontrada|не найдена|is not here|gibt es nicht|n'existe pas|no existe|não existe|нет или)\b"
    r"|\bthe page you asked for\b|\bpage non trouvée\b|\bseite .{0,30}nicht oder nicht mehr\b|\b(?:40[0-9]|41[0-9]|50[0-9])\s*[–—:-]\s*\S"
    r"|\b(?:access denied|zugriff verweigert|accès refusé|acceso denegado|acesso negado|доступ (?:запрещ|закрыт))"
    r"|\b(?:bad gateway|gateway timeout|service unavailable|internal server error|fatal error|uncaught exception|stack trace|no answer from upstream)\b"
    r"|\b(?:do not have permission|dürfen diese adresse nicht|pas le droit de voir|no tiene permiso|não tem (?:permissão|autorização)|нет прав\w*|not allowed to view)\b"
    r"|\b(?:unexpected error|unerwarteter fehler|erreur inattendue|error inesperado|erro inesperado|непредвиденн\w+ ошибк\w+|something went wrong|etwas ist schiefgegangen|etwas ist schiefgelaufen|une erreur est survenue|algo salió mal|algo correu mal|что-то пошло не так)\b"
    r"|\b(?:planned maintenance|wartungsarbeiten|maintenance en cours|mantenimiento|em manutenção|технически\w+ работ\w+)\b"
    r"|\b(?:cannot answer right now|derzeit nicht erreichbar|vorübergehend nicht|momentanément indisponible|no está disponible|está indisponível|временно недоступ\w+)\b"
    r"|\b(?:checking that you are a human|prüfen, ob sie ein mensch|vérifions que vous êtes|comprobando que (?:usted )?es|verificar que é humano|проверяем, что вы)\b"
    r"|\b(?:revenez dans|versuchen sie es in|try again in|tente de novo|inténtelo de nuevo|vuelva a intentarlo|повторите попытку|попробуйте через)\b"
    r"|\b(?:check the address|prüfen sie die adresse|vérifiez l'adresse|revise la dirección|verifique o endereço|проверьте адрес)\b"
)
_SCRIPT = (
    r"\b(?:enable|activate|switch on|turn on|allow|einschalten|aktivieren|schalten sie|erlauben|activer|activez|autoriser|autorisez|active|habilite|permita|ative|включите|разрешите)\b.{0,30}\b(?:java ?script|scripts?|скрипт\w*|javascript)\b"
    r"|\b(?:java ?script|scripts?|scripting)\b.{0,40}\b(?:einschalten|aktivieren|ein, um|erforderlich|required|is turned off|is disabled|deaktiviert|désactivé|desactivado|desativado|отключ\w+)\b"
    r"|\b(?:this application needs scripts|diese anwendung braucht (?:java)?scripts?|cette application a besoin (?:des|de) scripts|esta aplicación necesita|esta aplicação precisa|этому приложению нужн\w+|приложение требует)\b"
    r"|\byour browser is not supported\b|^noscript$|^loading(?:…|\.\.\.)|^(?:chargement|wird geladen|cargando|a carregar|carregando|загрузка)\b.{0,12}$|\bif nothing happens\b"
)
_FILLER = (
    r"\byour text (?:goes )?here\b|\breplace this (?:paragraph|text)\b|\bsample (?:heading|copy|text|subheading)\b|\bdummy (?:copy|text)\b|\bplaceholder (?:text|copy|heading)\b|\btodo:? write\b|\blorem ipsum\b"
    r"|\b(?:hier steht später ihr text|blindtext|platzhalter für|mustertext)\b|\b(?:votre texte ici|votre texte va ici|faux texte|texte de remplissage)\b|\b(?:su texto aquí|va su texto|su texto va aquí|es s[oó]lo de relleno|texto de relleno|texto de muestra|escriba aquí)\b"
    r"|\b(?:o seu texto aqui|vai o seu texto|seu texto aqui|só para encher|texto de exemplo|texto de preenchimento)\b|\b(?:здесь будет (?:ваш )?текст|ваш текст|текст-заполнитель|рыба-текст|текст для заполнения|пример текста)\b"
)
#: Things and states of notices; either may come first, with a few words between.
_THING = (
    r"(?:pages?|urls?|websites?|web ?sites?|sites?|servers?|requests?|documents?|resources?|files?|connections?|services?|sessions?|links?|content|browsers?|databases?|hosts?|operation"
    r"|seiten?|anfragen?|dokumente?|dateien?|verbindung(?:en)?|dienste?|sitzung|inhalte?|webseiten?|datenbank"
    r"|pages? web|requête|serveur|ressource|fichiers?|connexion|session|contenu|navigateur|base de données"
    r"|páginas?|sitios?|servidor|solicitud|petición|recursos?|archivos?|conexión|sesión|contenidos?|navegador|base de datos"
    r"|pedido|solicitação|ficheiros?|arquivos?|conexão|ligação|sessão|conteúdos?"
    r"|страниц\w*|сайт\w*|сервер\w*|запрос\w*|документ\w*|ресурс\w*|файл\w*|соединени\w*|сервис\w*|сесси\w*|содержимо\w*|браузер\w*)"
)
_STATE = (
    r"(?:(?:was|were|is|are|could|can|has|have|does|did)(?:n['’]t| ?not| no longer| never)\b.{0,20}\b(?:found|exist|available|accessible|reached|loaded|displayed|processed|completed|supported|valid|be served|established|responding)"
    r"|timed out|time-?out|has expired|have expired|been (?:removed|deleted|blocked|suspended|moved permanently)|is (?:down|offline|overloaded|unreachable|broken|forbidden|missing|unavailable)|refused to connect|took too long|under construction|failed to load"
    r"|nicht (?:gefunden|verfügbar|erreichbar|geladen|verarbeitet|vorhanden|unterstützt)|existiert nicht|(?:ist|sind) abgelaufen|wurde (?:gelöscht|entfernt|gesperrt|abgelehnt)|fehlgeschlagen|überlastet|zeitüberschreitung"
    r"|n['’](?:a pas pu|existe pas|est pas disponible|est plus disponible|a pas été trouvée?)|(?:a|est) expirée?|a été (?:supprimée?|bloquée?|refusée?)|a échoué|délai d['’]attente|(?:introuvable|inaccessible|indisponible|surchargée?)"
    r"|no (?:se (?:ha )?(?:encontr\w+|pudo)|está disponible|existe|responde)|ha (?:caducado|expirado|fallado)|ha sido (?:eliminad\w|bloquead\w)|tiempo de espera|sobrecargad\w"
    r"|não (?:foi (?:encontrad\w|possível)|está disponível|existe|responde|pôde)|(?:expirou|falhou|excedeu o tempo)|foi (?:removid\w|bloquead\w)|tempo (?:limite|esgotado)"
    r"|не (?:найден\w*|существует|доступ\w+|отвечает|удалось|поддерживается)|недоступ\w+|ист[её]к\w*|удал[её]н\w*|заблокирован\w*|перегружен\w*|превышено время)"
)
_GENERIC = (
    rf"\b{_THING}\b[^.!?]{{0,40}}\b{_STATE}|\b{_STATE}[^.!?]{{0,30}}\b{_THING}\b"
    r"|\b(?:http(?: status)?|error|fehler|erreur|ошибка|erro)\W{0,3}(?:code\W{0,2})?[45]\d\d\b|\b[45]\d\d\W{1,3}(?:error|not found|forbidden|bad request|unauthorized|gone)\b"
    r"|\b(?:forbidden|unauthorized|bad request|too many requests|not authorized|zu viele anfragen|trop de requêtes|demasiadas solicitudes|muitos pedidos|слишком много запросов)\b"
    r"|\b(?:request|connection|session|gateway|operation)\W{1,2}(?:timed? ?out|timeout|failed|expired|refused|reset)\b|\b(?:coming soon|under construction|im aufbau|en construction|en construcción|em construção|на реконструкции|в разработке)\b"
    r"|\b(?:java ?script|cookies|скрипты?|javascript)\b[^.!?]{0,30}\b(?:must|needs? to|has to|is|are|muss|müssen|doit|doivent|debe|deben|deve|devem|должн\w+)\b[^.!?]{0,15}\b(?:enabled|turned on|activated|required|allowed|aktiviert\w*|eingeschaltet|activée?s?|activad[oa]s?|habilitad[oa]s?|ativad[oa]s?|включ\w+)\b"
    r"|\b(?:please|bitte|veuillez|por favor|пожалуйста)\b[^.!?]{0,25}\b(?:enable|activate|allow|update|upgrade|aktivieren|einschalten|activer|activez|active|habilite|ative|actualice|atualize|mettre à jour|aktualisieren|включите|обновите)\b[^.!?]{0,25}\b(?:java ?script|cookies|browser|navigateur|navegador|скрипт\w*|браузер\w*)\b"
    r"|\b(?:your|ihr|votre|su|seu|ваш)\b[^.!?]{0,15}\b(?:text|content|title|heading|inhalt|titel|texte|contenu|titre|texto|contenido|título|conteúdo|текст|заголовок)\b[^.!?]{0,15}\b(?:goes here|here|hier|ici|aquí|aqui|здесь)\b"
    r"|\b(?:insert|add|place|enter|type|hier|insérez|ajoutez|inserte|escriba|insira|вставьте|введите)\b[^.!?]{0,20}\b(?:text|content|description|title|inhalt|titel|texte|contenu|texto|contenido|conteúdo|текст)\b[^.!?]{0,12}\b(?:here|hier|ici|aquí|aqui|здесь|einfügen)\b"
)
NOTICE = re.compile("|".join((_ERROR, _SCRIPT, _FILLER, _GENERIC)))
#: The words of the customary dummy Latin.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur".split()
)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
_WORD = re.compile(r"[^\W\d_]+")


#: Every notice holds one of these stems; sentences without any are not searched further.
STEMS = (
    r"script|скрипт|not found|introuvable|gefunden|encontrad|не найден|not here|gibt es nicht|n'existe|no existe|não existe|нет или|asked for|trouvée|nicht mehr|\b[45][01]\d\b"
    r"|denied|verweigert|refusé|denegado|negado|доступ|gateway|unavailable|server error|fatal|exception|stack trace|upstream|permission|dürfen|droit de|permiso|permissão|autorização|нет прав"
    r"|allowed to|unexpected|unerwartet|inattendue|inesperado|непредвид|went wrong|schiefge|survenue|salió mal|correu mal|пошло не|maintenance|wartung|mantenimiento|manutenção|технич"
    r"|right now|derzeit|vorübergehend|indisponible|disponible|indisponível|human|mensch|vérifions|comprobando|verificar|проверяем|revenez|versuchen|try again|tente de|inténtelo|intentarlo|повторите|попробуйте"
    r"|the address|die adresse|l'adresse|dirección|endereço|адрес|javascript|not supported|loading|chargement|geladen|cargando|carregar|carregando|загрузка|nothing happens"
    r"|[45]\d\d|time|expir|removed|deleted|blocked|suspended|moved|down|offline|overload|unreach|broken|forbidden|missing|refused|long|construc|fail|could|can[n'’]|n['’]t|has n|does n|did n|is n|was n|no longer"
    r"|verfügbar|erreichbar|verarbeitet|vorhanden|existiert|abgelaufen|gelöscht|entfernt|gesperrt|abgelehnt|fehlgeschlagen|überlast|zeitüber|n['’]a |n['’]est|échou|supprim|bloqu|délai|inaccess|surcharg|no se|no responde|caducad|fallad|eliminad|espera|sobrecarg"
    r"|não|falhou|removid|tempo|не |недоступ|ист[её]к|удал|заблок|перегруж|превыш|error|fehler|erreur|erro|ошибк|many|viele|trop|demasiad|muitos|слишком|soon|aufbau|разработк|реконструк|cookies|browser|navigateur|navegador|браузер|unauthorized|bad request|authorized|reset"
    r"|content|title|inhalt|titel|contenu|contenid|conteúdo|заголов|вставьте|введите|text|texte|texto|sample|dummy|placeholder|todo|ipsum|platzhalter|текст|рыба"
)
_STAMP = re.compile(r"^\S+ [–—-] [\d./-]{8,10}$|^\S*$")
#: A line up to this length is a notice as a whole when one sentence of it is.
NOTICE_LINE = 200
#: A line is learned as a notice: characters it must have, hosts on whose pages without a body it must stand,
#: and the share of those pages that must show a seed.
LEARNED_CHARS, LEARNED_HOSTS, LEARNED_SHARE = 20, 3, 0.8


def placeholders(text: str) -> int:
    """Unfilled placeholders of a text, mentions in quotes or backticks aside."""
    if not any(c in text for c in "{[$%@_<u*#"):
        return 0
    return len(PLACEHOLDER.findall(_QUOTED.sub(" ", text)))


def is_latin(words: list[str]) -> bool:
    return len(words) >= 4 and sum(w in LATIN for w in words) >= 0.8 * len(words)


def is_notice(sentence: str) -> bool:
    """Is a lower-case sentence filler, an error or a script notice?"""
    return bool(NOTICE.search(sentence)) or is_latin(_WORD.findall(sentence))


def title_notice(title: str) -> bool:
    low = " ".join(title.lower().split())
    return bool(low) and is_notice(low)


def is_stamp(line: str) -> bool:
    """A server's version and date, or a lone token: neither content nor a notice."""
    return bool(_STAMP.match(line.strip()))


def learned_lines(facts: DataFrame) -> DataFrame:
    """key of each line that is learned as a notice, from facts(host_key, bare(key, chars), notice_share)."""
    lines = facts.select("host_key", (F.col("notice_share") > 0).alias("seeded"), F.explode("bare").alias("line")).select("host_key", "seeded", F.col("line.key").alias("key"))
    by_host = lines.groupBy("key", "host_key").agg(F.count("*").alias("n"), F.sum(F.col("seeded").cast("long")).alias("seeds"))
    by_key = by_host.groupBy("key").agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum("seeds").alias("seeds"))
    return by_key.where((F.col("hosts") >= LEARNED_HOSTS) & (F.col("seeds") >= LEARNED_SHARE * F.col("n"))).select("key")


def with_learned(facts: DataFrame) -> DataFrame:
    """facts, their notice_share raised by the characters of learned lines."""
    lines = facts.select("page_id", F.explode("bare").alias("line")).select("page_id", F.col("line.key").alias("key"), F.col("line.chars").alias("chars"))
    more = lines.join(learned_lines(facts), "key", "left_semi").groupBy("page_id").agg(F.sum("chars").alias("more"))
    share = (F.col("notice_share") * F.col("content") + F.coalesce("more", F.lit(0.0))) / F.greatest("content", F.lit(1.0))
    return facts.join(more, "page_id", "left").withColumn("notice_share", F.least(share, F.lit(1.0)).cast("float")).drop("more", "bare", "content")
