"""Problem 5: template residue, filler, error messages and notices that scripts are required."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.lines import line_support, keyed_lines, normal_line, site_of
from skein.session import written

MIN_SUPPORT = 8
PROSE_CHARS = 60

# How template languages write a slot, and what stands where one was filled wrongly.
SLOTS = (
    r"\{\{[^{}\n]++\}\}",
    r"\{%[^%\n]++%\}",
    r"<%[=-]?[^%\n]++%>",
    r"<\?(?:php|=)[^?\n]++(?:\?(?!>)[^?\n]*+)*+\?>",
    r"[$#]\{[A-Za-z_][\w.]*+\}",
    r"(?<![\w\\^_{])\{(?:\d|[A-Za-z]\w*[_.]\w+|[A-Z][A-Z_]{2,})\}",
    r"%%[A-Za-z_]{2,}+%%",
    r"@@[A-Za-z_]{2,}+@@",
    r"##[A-Za-z_]{2,}+##",
    r"(?<![A-Za-z])__[A-Z](?:[A-Z]|_(?!_))++__",
    r"(?<!\S)\$[A-Z][A-Z_]{2,}+\$?(?!\w)",
    r"(?<!\S)%[A-Z_]{3,}+%(?!\w)",
    r"\[\[[A-Za-z_][\w. ]*+\]\]",
    r"(?<!\S)%[sd](?=\s)",
    r"\[(?:INSERT|ENTER|ADD|YOUR|PLACEHOLDER|TITLE|NAME|DATE|TEXT|INS[ÉE]RER|NOM|TITRE|INSERTAR|NOMBRE|HIER|WERT|TEXT)\b[^\]\n]*+\](?!\()",
    r"\[(?:[Pp]rénom|[Nn]om|[Tt]itre|[Nn]ombre|[Aa]pellido|[Tt]ítulo|[Aa]nrede|[Nn]ame|[Vv]orname|[Nn]achname|[Tt]itel|[Ff]irst ?[Nn]ame|[Ll]ast ?[Nn]ame|[Tt]itle|[Dd]ate|[Vv]alue)\](?!\()",
    r"(?:<|&lt;)(?:YOUR|INSERT|ENTER|VOTRE|IHR|SU|TU)\b[A-Z ]{2,}+(?:>|&gt;)",
    r"(?:<|&lt;)placeholder\b[^>&\n]*+(?:&(?!gt;)[^>&\n]*+)*+(?:>|&gt;)",
    r"\[object Object\]",
    r"\bInvalid Date\b",
    r"\b(?:by|from|on|at|of|is|was|to|with|par|von|por)\s+(?:undefined|NaN|null)(?![\w-])(?!\s+[a-z])",
    r"[=:]\s*(?:undefined|NaN)\b",
    r"\bXX+[.,:]XX+\b",
    r"(?<![\w])(?:TODO|FIXME)\b\s*:",
)
# Openings of the messages that servers and applications show in place of a page.
ERRORS = (
    r"(?:https? )?(?:error|erreur|fehler)(?: code| http)?[ :#]*[1-5]\d\d\b",
    r"[45]\d\d[ :–-]*(?:error|not found|forbidden|unauthori[sz]ed|bad (?:request|gateway)|internal (?:server )?error|gone|too many requests|service (?:temporarily )?unavailable|gateway time-?out|request time-?out|method not allowed|page)",
    r"(?:fatal|parse|uncaught|unhandled|database|internal server|runtime) (?:error|exception)\b",
    r"traceback \(most recent call last\)",
    r"(?:the |this )?(?:page|document|address|resource|file|content|url)(?: that)?(?: you)?(?: (?:asked for|requested|are looking for|were looking for|wanted))?,? (?:is not (?:on|available)|was not found|could ?n[o']t be found|can(?:no|')t be found|does(?: not|n't) exist|has been (?:removed|deleted|moved)|is no longer|not found|has (?:moved|expired))",
    r"(?:oops|sorry|whoops)[!,.]* (?:we|that|this|the) .{0,30}(?:can'?t|cannot|could ?n[o']t|not) .{0,20}(?:find|found|load|exist)",
    r"(?:page |file )?not found\b",
    r"access (?:denied|forbidden|to this (?:page|resource))",
    r"you (?:do not|don't) have (?:permission|access)",
    r"too many requests",
    r"something went wrong",
    r"an (?:unexpected |internal )?error (?:has )?occurred",
    r"(?:please )?(?:try|come) (?:again|back) (?:later|in a)",
    r"(?:we are )?(?:down|closed|offline) for (?:scheduled )?maintenance",
    r"(?:site|server|system|scheduled) (?:is )?(?:under |down for )?maintenance",
    r"(?:the )?(?:service|server|site)(?: is)? (?:temporarily |currently )?(?:un|not )available",
    r"your session (?:has )?(?:expired|timed out)",
    r"please (?:go back|log in|sign in) and (?:start|try) again",
    r"(?:connection|request|gateway|server) (?:has )?timed? ?-?out",
    r"(?:could not|cannot|can't|unable to) connect to",
    r"(?:la |cette )?page(?: que vous)?(?: demandée| recherchée| cherchez)? (?:est introuvable|n'existe|n’existe|a été (?:supprimée|déplacée))",
    r"page (?:introuvable|non trouvée)",
    r"accès (?:refusé|interdit)",
    r"vous n'(?:avez pas|êtes pas) (?:le droit|la permission|l'autorisation|autorisé)",
    r"(?:le )?(?:service|serveur|site)(?: est)? (?:temporairement )?indisponible",
    r"(?:merci de|veuillez) réessayer",
    r"(?:une )?erreur (?:est survenue|interne|inattendue)",
    r"(?:site |page )?en maintenance|maintenance en cours",
    r"(?:votre )?session (?:a )?expiré",
    r"(?:die )?(?:angeforderte |gesuchte )?seite (?:wurde nicht gefunden|nicht gefunden|existiert nicht|ist nicht)",
    r"zugriff (?:verweigert|nicht)",
    r"(?:sie haben keine|ihnen fehlt die) berechtigung",
    r"(?:der )?(?:dienst|server|service)(?: ist)? (?:vorübergehend |derzeit |zurzeit )?nicht (?:verfügbar|erreichbar)",
    r"wartungsarbeiten|(?:wegen )?wartung\b",
    r"(?:es ist )?ein (?:interner |unerwarteter )?fehler (?:ist )?aufgetreten",
    r"bitte (?:später|versuchen sie es (?:später )?)(?: erneut| noch einmal| nochmals)?",
    r"(?:ihre )?sitzung (?:ist )?abgelaufen",
    r"no se (?:encuentra|encontró|ha encontrado|pudo encontrar) (?:la|esta) página",
    r"(?:la )?página(?: solicitada| que busca)? (?:no (?:existe|encontrada|se encuentra|está)|ha sido)",
    r"acceso (?:denegado|prohibido)",
    r"(?:usted )?no (?:tiene|dispone de) (?:permiso|autorización|acceso)",
    r"(?:el )?servicio(?: temporalmente)? no disponible",
    r"(?:inténtelo|inténtalo|vuelva a intentarlo) (?:de nuevo|más tarde|otra vez)",
    r"(?:se ha producido|ocurrió) un error",
    r"(?:en|sitio en) mantenimiento",
    r"(?:su )?sesión (?:ha )?(?:expirado|caducado)",
)
# Notices that a page needs scripts, cookies or another browser.
SCRIPTS = (
    r"(?:please |you (?:need|have) to |you must )?(?:enable|turn on|activate|allow|switch on) (?:javascript|scripts?|scripting|cookies)\b",
    r"(?:javascript|scripting|scripts?) (?:is|are|must be|has to be|seems to be) (?:disabled|required|needed|switched off|turned off|not enabled|blocked|enabled|on\b|off\b)",
    r"(?:your|this) (?:browser|viewer|page|site|application|app) (?:does not|doesn't|requires?|needs?) .{0,40}(?:script|javascript)",
    r"(?:checking|verifying) (?:your browser|that you are|if you are)",
    r"this (?:takes|may take) a few seconds; .{0,40}(?:scripts?|javascript)",
    r"to run this application\.?$",
    r"(?:veuillez |merci d')?(?:activer|autoriser|activez) (?:javascript|les scripts)",
    r"javascript (?:est|doit être) (?:désactivé|requis|nécessaire|activé)",
    r"(?:votre|ce) navigateur .{0,40}(?:script|javascript)",
    r"(?:bitte |sie müssen )?(?:aktivieren sie|schalten sie) (?:bitte )?(?:javascript|skripte)",
    r"(?:bitte )?javascript (?:ist|muss|wird|aktivieren)",
    r"ohne (?:aktive |aktiviertes )?(?:skripte|javascript)",
    r"(?:ihr|dieser) browser .{0,40}(?:skript|javascript)",
    r"(?:por favor,? )?(?:active|activa|habilite|debe activar) (?:javascript|los scripts)",
    r"(?:los scripts|javascript) (?:están|está|deben?|es) ",
    r"(?:les )?scripts (?:sont|doivent)\b",
    r"(?:die )?skripte (?:sind|müssen)\b",
    r"(?:su|este) navegador .{0,40}(?:script|javascript)",
)
# Filler that editors leave in a page.
FILLERS = (
    r"lorem ipsum",
    r"(?:your|the) (?:story|text|content|article|copy|title|heading) (?:begins|starts|goes|comes) here",
    r"(?:insert|add|enter|type|put|replace|write) (?:your |the |an? )?(?:article |body |own |sample )?(?:text|content|copy|words|story|article|paragraph) (?:here|below)",
    r"(?:article|body) (?:text|copy) (?:here|goes)",
    r"this is (?:a |an |some )?(?:sample|dummy|example|placeholder|test) (?:paragraph|text|page|post|content)",
    r"(?:sample|dummy|placeholder) (?:text|content|copy)",
    r"(?:coming soon: ?)?body copy",
    r"(?:coming soon|under construction|text to follow|tbd|tba)\b[^.]{0,30}\.?$",
    r"texte (?:provisoire|à venir|de remplissage|ici)",
    r"(?:votre|insérez|saisissez|écrivez)(?: votre| le)? texte",
    r"(?:exemple de (?:paragraphe|texte)|(?:paragraphe|texte) d'exemple)",
    r"(?:platzhalter|blind|muster|beispiel)(?:text|absatz)",
    r"(?:hier|ihr) (?:(?:steht|kommt|folgt|erscheint)(?: [^ ]+){0,3} |ihr(?:en)? )?text\b",
    r"text folgt",
    r"(?:escriba|inserte|introduzca|ponga|añada)(?: aquí)? (?:su|el) texto",
    r"(?:párrafo|contenido) de (?:relleno|ejemplo|muestra|prueba)",
    r"paragraphe (?:à remplacer|de remplissage|provisoire|d'exemple)",
    r"texto (?:de (?:relleno|ejemplo|prueba)|provisional|aquí|pendiente)",
    r"(?:asdf|qwer|qwertz|hjkl|jklö|jkl)\w* +(?:asdf|qwer|qwertz|hjkl|jklö|jkl)",
    r"(\p{L}{2,})[\s,.]+\1[\s,.]+(?:\1|\d+)\b",
    r"(\S.{4,80}?[.,!])\s*\2",
    r"(\S.{4,80}?)[.,;!]\s*\3[.,;!]?\s*$",
)

# The commonest function words of English, French, German and Spanish; filler in false Latin has none.
FUNCTION_WORDS = (
    "the of and to in is it that for on with as at by from this an was are be or not has which its their "
    "le la les des du un une et est en que qui dans pour sur par au aux ne pas plus ce se sont son sa "
    "der die das und den dem des ein eine einer ist von mit zu auf für im nicht sich auch aus bei nach wird "
    "el los las una y es por con para del se su al lo como más no sus ha"
).split()
#: What any slot contains: one of these signs or words. Lines without them skip the list above.
SLOT_SIGNS = r"[{}<@#_$\[]|%[A-Za-z%]"
SLOT_WORDS = ("&lt;", "Invalid", "undefined", "NaN", "null", "XX", "TODO", "FIXME")
SLOT = "(?:" + "|".join(SLOTS) + ")"
LEAD = r"^[\s#*>_=|\-]*+"


def _starting(patterns: tuple[str, ...]) -> str:
    """A line in lower case that starts with one of the patterns, whatever marks stand before it."""
    return LEAD + "(?:" + "|".join(patterns) + ")"


def _false_latin(line: Column) -> Column:
    """Eight or more plain words in a row and not one function word of the four languages among them."""
    return line.rlike(r"^\s*\p{L}+(?:[,.]? \p{L}+){7}") & ~line.rlike(r"[\d|·>]") & ~line.rlike(r"\b(?:" + "|".join(FUNCTION_WORDS) + r")\b")


def evidence(line: Column) -> Column:
    """Which evidence one line gives: slot, error, scripts, filler, or null."""
    low = F.lower(line)
    hinted = line.rlike(SLOT_SIGNS)
    for word in SLOT_WORDS:
        hinted |= F.contains(line, F.lit(word))
    # One pass turns nearly all lines away; the few that are left are told apart.
    message = low.rlike(_starting(FILLERS + ERRORS + SCRIPTS)) | _false_latin(low)
    which = F.when(low.rlike(_starting(SCRIPTS)), F.lit("scripts")).when(low.rlike(_starting(ERRORS)), F.lit("error")).otherwise(F.lit("filler"))
    return F.when(hinted & line.rlike(SLOT), F.lit("slot")).when(message, which)


def is_prose(line: Column) -> Column:
    """A line that only an article has: a sentence of some length with a figure in it."""
    return (F.length(line) >= PROSE_CHARS) & line.rlike(r"\d") & line.rlike(r"[.!?…][\"”»’)\]]*\s*$") & ~line.rlike(r"^\s*(?:[*\-]\s*)?\[")


def subject_of(url: Column) -> Column:
    """The last words of the URL's path without a number at their end, between hyphens; null if there are none."""
    path = F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.\-]*://)?[^/?#]*/(?:[^?#]*/)?([^/?#]+)/?(?:[?#].*)?$", 1)
    slug = F.regexp_replace(F.regexp_replace(path, r"\.\w{2,5}$", ""), r"-\d+$", "")
    return F.when(slug.rlike("[a-z]"), F.concat(F.lit("-"), slug, F.lit("-")))


def named_in_path(lines: Column) -> Column:
    """The same of the last step of the first line that is a path ("Home > News > Name 7"), for pages without URL."""
    path = F.get(F.filter(lines, lambda x: x.rlike(r"^[^.!?\n]*?\S(?: [>/›»] [^>/›».!?\n]+)+\s*$")), F.lit(0))
    last = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(path, r"([^>/›»]+)$", 1)), r"[^\p{L}\p{N}]+", "-"), r"^-|-?\d*-?$", "")
    return F.when(last.rlike(r"\p{L}"), F.concat(F.lit("-"), last, F.lit("-")))


def names_subject(line: Column, subject: Column) -> Column:
    return F.contains(F.concat(F.lit("-"), F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", "-"), F.lit("-")), subject)


def recurrent_lines(pages: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """(site_key, line_key, everywhere) of the lines on at least ``min_support`` URLs of their site; everywhere: on all of them."""
    keyed = keyed_lines(pages)
    urls = (
        pages.where(F.col("url").isNotNull())
        .select(F.xxhash64(site_of(F.col("url"))).alias("site_key"), F.xxhash64("url").alias("url_key"))
        .groupBy("site_key")
        .agg(F.count_distinct("url_key").alias("site_urls"))
    )
    often = line_support(keyed).where(F.col("n_urls") >= min_support)
    return often.join(urls, "site_key").select("site_key", "line_key", (F.col("n_urls") == F.col("site_urls")).alias("everywhere"))


def residual_evidence(pages: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """page_id, kind, slots, messages, prose: what is left of each suspect page once the site's boilerplate is gone.

    Suspects are the pages with a line of evidence; ``messages`` counts its lines that are an error, filler or script
    notice, ``slots`` those with an unfilled slot, ``prose`` its lines of article text. ``kind`` is the evidence named
    first of slot, error, scripts, filler. Null, empty and blank chunks are no suspects; pages without URL have no site,
    so nothing is subtracted from them, and their subject is the last step of their path. A recurring message is boilerplate only if most URLs that carry it also have article
    text, or if all URLs of the site carry it; a slot never is.
    """
    order = F.array(*map(F.lit, ("slot", "error", "scripts", "filler")))
    lines = pages.where(F.col("chunk").isNotNull()).select("page_id", "url", "chunk", F.split("chunk", "\n", -1).alias("lines"))
    suspects = lines.withColumn("marks", F.transform("lines", evidence)).where(F.exists("marks", lambda m: m.isNotNull()))
    subject = F.when(F.col("url").isNotNull(), subject_of(F.col("url"))).otherwise(named_in_path(F.col("lines")))
    parts = suspects.withColumn("subject", subject).select("page_id", "url", "subject", F.explode(F.arrays_zip("lines", "marks")).alias("part")).select(
        "page_id",
        F.xxhash64(site_of(F.col("url"))).alias("site_key"),
        F.xxhash64("url").alias("url_key"),
        F.xxhash64(normal_line(F.col("part.lines"))).alias("line_key"),
        F.col("part.marks").alias("mark"),
        (is_prose(F.col("part.lines")) & (F.col("subject").isNull() | names_subject(F.col("part.lines"), F.col("subject")))).alias("prose"),
    )
    parts = parts.where(F.col("mark").isNotNull() | F.col("prose"))
    parts = parts.join(recurrent_lines(pages, min_support), ["site_key", "line_key"], "left").withColumn("recurs", F.col("everywhere").isNotNull())
    parts = written(parts)
    message = F.col("mark").isNotNull() & (F.col("mark") != "slot")
    articles = parts.where(F.col("mark").isNull() & ~F.col("recurs")).select("site_key", "url_key", F.lit(True).alias("article")).distinct()
    carriers = parts.where(message & F.col("recurs")).select("site_key", "line_key", "url_key", "everywhere").distinct()
    framed = (
        carriers.join(articles, ["site_key", "url_key"], "left")
        .groupBy("site_key", "line_key")
        .agg(F.count(F.lit(1)).alias("urls"), F.count("article").alias("articles"), F.max("everywhere").alias("everywhere"))
        .where(F.col("everywhere") | (2 * F.col("articles") > F.col("urls")))
        .select("site_key", "line_key", F.lit(True).alias("framed"))
    )
    gone = F.col("recurs") & (F.col("mark").isNull() | (message & F.col("framed").isNotNull()))
    left = parts.join(framed, ["site_key", "line_key"], "left").where(~gone)
    return left.groupBy("page_id").agg(
        F.element_at(order, F.min(F.array_position(order, F.col("mark"))).cast("int")).alias("kind"),
        F.count_if(F.col("mark") == "slot").alias("slots"),
        F.count_if(F.col("mark").isin("error", "scripts", "filler")).alias("messages"),
        F.count_if(F.col("mark").isNull() & F.col("prose")).alias("prose"),
    )


def residue_pages(pages: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """page_id, kind of the pages to leave out.

    A page is out if its residual shows an unfilled slot, or holds a message and no article text.
    """
    left = residual_evidence(pages, min_support)
    return left.where((F.col("slots") > 0) | ((F.col("messages") > 0) & (F.col("prose") == 0))).select("page_id", "kind")


def keep_content(pages: DataFrame) -> DataFrame:
    """The pages with real content: ``pages`` without those of :func:`residue_pages`."""
    return pages.join(residue_pages(pages).select("page_id"), "page_id", "left_anti")
