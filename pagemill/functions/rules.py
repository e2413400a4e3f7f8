"""Fixed values of the rule-based operators: patterns, word lists, weights.

They must equal the values that the rules prescribe, else results differ.
Patterns are matched against lower-case text.
"""

# -- fixed values: URL classes --------------------------------------------------
SUBDOMAINS = r"^(embed|player|video|stream|cdn|media|static|files|assets|img|image|download|descarg)\."
SUBDOMAIN_TYPES = (
    ("embed", "embed|player|video|stream", 75),
    ("cdn", "cdn|static|files|assets|img|image", 70),
    ("download", "download|descarg", 70),
)
ALT_TLDS = r"\.(tv|to|cc|me|xyz|top|click)$"
EXTENSION_TYPES = (
    ("direct-video", r"\.(mp4|mkv|avi|webm|mov|flv|wmv)($|\?)", 95),
    ("stream", r"\.(m3u8|mpd|hls)($|\?)", 90),
    ("download", r"\.(zip|rar|7z|tar|gz)($|\?)", 80),
)
#: (signal, type, pattern, confidence, container)
PATH_RULES = (
    ("path:embed", "embed", r"/embed/|/player/|/reproductor/|embed\.php|player\.php|reproductor", 75, True),
    ("path:player", "embed", r"/online/|/watch/|/play/|\.php\?", 70, True),
    ("path:download", "download", r"/download/|/descargar/|/d/|/descarga/|download\.php|descargar\.php", 70, False),
    ("path:video", "direct-video", r"/video/|/v/|/stream/|\.mp4|\.m3u8", 65, False),
    ("path:episode", "navigation", r"/e/|/episodio/|/episode/|/capitulo/|/chapter/|/ver/", 60, True),
)
CONTEXT_RULES = (
    ("ctx:server", "embed", "server|servidor|mirror|opcion", 65, True),
    ("ctx:download", "download", "download|descarg", 65, False),
    ("ctx:play", "embed", "play|reproduc|ver|watch", 60, True),
    ("ctx:episode", "navigation", "episodio|episode|capitulo|chapter", 55, False),
    ("ctx:language", None, "idioma|language|lang", 50, False),
)
QUERY_AUTH = r"[?&](token|auth|key|api|session|sid)="
QUERY_REDIRECT = r"[?&](redirect|url|goto|return|next)="
TRACKING_HOSTS = "analytics|track|pixel|beacon|stats|metric|collect"
AD_HOSTS = "analytics|track|pixel|beacon|adexchange|cookielaw|cookiepedia|onetrust|doubleclick|googlesyndication|googletagmanager"
SERVER_PREFIXES = r"^(www\.|embed\.|player\.|cdn\.|api\.|static\.|media\.|files\.|img\.)"
AFFILIATE_DOMAINS = (
    "techsmartideas.com", "financemasterpro.com", "sweettoothrecipes.com", "ouo.io", "ouo.press", "shrinkme.io", "linkvertise.com",
    "adf.ly", "bc.vc", "short.am", "exe.io", "stfly.me", "rexdl.com", "lnkfy.com",
)
KNOWN_SERVERS = (
    "StreamTape", "StreamWish", "Filemoon", "DoodStream", "MixDrop", "VOE", "VidHide", "VidMoly", "UpStream", "UpToBox", "Vidoza", "VidLox", "VidFast",
    "SendVid", "Fembed", "BurstCloud", "GoUnlimited", "Hydrax", "SBEmbed", "SBPlay", "MyStream", "CloudVideo", "JawCloud", "WolfMax4K", "StreamLare",
    "Vudeo", "TapeContent", "CDNWish", "EmbedWish", "MP4Upload", "Netu", "HQQ", "OKru", "MEGA", "YourUpload", "Uqload", "Google Drive", "Dropbox",
    "MediaFire", "ZippyShare", "1Fichier", "YouTube", "Dailymotion", "Vimeo",
)

# -- fixed values: media streams ------------------------------------------------
QUALITIES = (
    ("4k", "4K"), ("2160", "4K"), ("uhd", "4K"), ("1080", "1080p"), ("full hd", "1080p"), ("fhd", "1080p"), ("hd 1080", "1080p"), ("720", "720p"), ("hd", "HD"),
    ("hd ready", "720p"), ("480", "480p"), ("sd", "SD"), ("360", "360p"), ("cam", "CAM"), ("camrip", "CAM"), ("telesync", "CAM"), ("hdts", "CAM"), ("hd cam", "CAM"),
)
LANGUAGES = (
    ("latino", "ES", 10), ("espanol", "ES", 10), ("castellano", "ES", 10), ("espanol latino", "ES", 10), ("audio latino", "ES", 10), ("subtitulado", "ES", 5),
    ("sub espanol", "ES", 5), ("ingles", "EN", 9), ("english", "EN", 9), ("japones", "JA", 8), ("japanese", "JA", 8), ("coreano", "KO", 7), ("korean", "KO", 7),
    ("portugues", "PT", 6), ("portuguese", "PT", 6), ("frances", "FR", 5), ("french", "FR", 5), ("chino", "ZH", 4), ("chinese", "ZH", 4), ("turco", "TR", 3),
    ("turkce", "TR", 3), ("turkish", "TR", 3),
)
STREAM_TYPES = (
    ("m3u8", r"\.m3u8(\?|$)"),
    ("mp4", r"\.mp4(\?|$)"),
    ("mkv", r"\.mkv(\?|$)"),
    ("webm", r"\.webm(\?|$)"),
    ("embed", "embed|iframe|player|watch|video|stream"),
    ("torrent", r"magnet:|\.torrent|tracker"),
)
QUALITY_POINTS = (("4K", 30), ("1080p", 25), ("720p", 15), ("HD", 10), ("CAM", -20))
LANGUAGE_POINTS = (("ES", 20), ("JA", 10), ("EN", 8))
TYPE_POINTS = (("mp4", 15), ("m3u8", 10), ("embed", -5), ("torrent", -10))
LABEL_POINTS = (("descarg|download", 5), ("server|servidor", 3), ("ad|publicidad|anuncio", -30))
DIRECT_VIDEO = r"\.(m3u8|mp4|mkv|webm|avi|ts|mov)(\?|$)|/hls/"

# -- fixed values: elements and pages -------------------------------------------
#: (action, base score, pattern for text, for class, for attributes)
ACTIONS = (
    ("play-video", 25, "play|reproduc|ver|watch|mirar|reproducir|stream|video|pelicula|movie|mirar", "player|video|reproduc|stream|watch", "play|video|stream|reproduc|embed"),
    ("switch-server", 25, "server|servidor|opcion|mirror|fuente|source|cdn|host|altern", "server|servidor|mirror|source|option", "server|source|mirror|cdn"),
    ("change-language", 25, "idioma|language|lang|audio|doblaje|dub|sub|subtit|castellano|latino|español|english|japanese|portuguese", "idioma|language|lang|audio|dub", "lang|language|audio|dub"),
    ("download", 25, "download|descarg|bajar|descarga|guardar", "download|descarg|btn-descarg", "download|descarg"),
    ("navigate-episode", 20, r"episodio|episode|capitulo|chapter|cap\.?\s*\d|ep\.?\s*\d|^\d{1,4}$", "episod|episode|capitul|chapter", "episod|episode|chapter"),
    ("navigate-page", 15, "siguiente|next|anterior|prev|»|«|pagina|page|catalogo|catalog|inicio|home", "pagin|page|nav|next|prev|naveg", "page|nav|next|prev"),
    ("search", 30, "buscar|search|busqueda|find|encontrar|filt", "search|buscar|filtro|filter|find", "search|buscar|filter"),
    ("filter", 20, "filtro|filter|categoria|category|genero|genre|año|year|tipo|type|orden", "filter|filtro|categor|genero|genre", "filter|categor"),
    ("sort", 15, "ordenar|sort|orden|ascendente|descendente|asc|desc|rating|popular", "sort|orden", "sort|order"),
    ("login", 20, "login|iniciar|regist|cuenta|account|sign.?in|sign.?up|perfil|profile", "login|auth|account|user|sign", "login|auth|account"),
    ("social", 20, "discord|telegram|facebook|twitter|instagram|whatsapp|reddit|youtube|tiktok", "social|share|discord|telegram", "social|share"),
    ("ad", 15, "publicidad|anuncio|advert|patrocin", "ad|ads|banner|publi|advert", "ad|ads"),
)
INTENT_POINTS = (
    ("play-video", 30), ("switch-server", 30), ("download", 25), ("navigate-episode", 20), ("change-language", 18), ("search", 10), ("filter", 12), ("sort", 5),
    ("navigate-page", 8), ("login", -20), ("social", -15), ("ad", -25),
)
ELEMENT_POINTS = (
    ("clickable", 15), ("link", 15), ("list-item", 12), ("input", 8), ("select", 8), ("iframe", 25), ("video", 30), ("media", 28), ("heading", 3), ("image", 3), ("container", -5),
)
#: (zone, pattern for class, for tag, for attributes)
ZONES = (
    ("header", "header|top|navbar|nav.?bar|masthead|banner", "header", "banner|header"),
    ("nav", "nav|menu|sidebar|side.?bar", "nav|aside", "navigation|menu"),
    ("content", "content|main|body|article|post|entry|principal|container|wrapper", "main|article|section", "main|content"),
    ("sidebar", "sidebar|side.?bar|widget|aside", "aside", "sidebar|complementary"),
    ("footer", "footer|bottom|pie", "footer", "footer|contentinfo"),
)
GOALS = (("manga", "manga|manhwa|cap[ií]tulo|chapter"), ("video", "anime|episodio|pelicula|serie"), ("download", "descarg|download|zip|rar"), ("image", "galer[ií]a|wallpaper|fanart"))
GENRES = "accion|comedia|drama|romance|fantasia|terror|aventura|action|comedy|drama|romance|fantasy|horror|adventure|shounen|shoujo|seinen|josei"
#: General names of a class: (name, pattern).
CLASS_FAMILIES = (
    ("*-server*", "server|servidor"), ("*-player*", "player|reproductor"), ("*-list*", "list|lista"), ("*-btn*", "btn|button|boton"), ("*-card*", "card|tarjeta|item"),
    ("*-tab*", "tab|pestaña"), ("*-lang*", "idioma|language|lang"), ("*-download*", "download|descarg"),
)
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "it", "as", "be", "no", "not",
    "de", "la", "el", "en", "y", "o", "con", "por", "un", "una", "los", "las", "del", "al", "se", "su", "le", "lo", "que", "es",
)

# -- fixed values: page scans ---------------------------------------------------
LIVE_ELEMENTS = 300
LIVE_ATTRIBUTES = ("id", "class", "href", "src", "onclick", "placeholder", "type", "alt", "title", "data-url", "data-src", "data-anime", "data-value", "aria-label", "role")
LIVE_DATA_URLS = ("data-url", "data-src", "data-video", "data-embed", "data-href", "data-link")
QUOTED_URL = r"https?://[^'\")\s]+"
ESCAPED_URL = r"https?:\\/\\/[^'\"\\)\s]+"
LOOSE_URL = r"https?://[^\"'\s<>]{10,300}"
SCRIPT_URL = r"https?://[^\s\"'\\]+"
CONTENT_URL = "player|embed|stream|video|download|descarg|mp4|m3u8|hls|source|server|cdn"
PLACEHOLDER = "placeholder|blank|loading|lazy|data:image|1x1|spacer"
PAGE_BLOCKS = ("pagin", "page", "naveg")
CARD_WORDS = ("card", "item", "entry", "row", "result", "product", "post", "list", "grid", "cell", "tile", "box")
#: (kind, pattern, whether link texts count besides the container's class)
LIST_KINDS = (
    ("episode-list", "episod|capitul|chapter", True),
    ("server-list", "server|servidor|player|reproductor|video", True),
    ("navigation", "nav|menu|header", False),
    ("search-results", "result|search", False),
)
PLAYER_BLOCKS = "server|servidor|player|reproductor|tab|option|source"
BATCH_SELECT = r"cargar\s+im[aá]genes|load\s+images|images?\s+per\s+page|batch\s+size|images?\s+at\s+once"
PAGE_SELECTS = ("sl-page", "page-select", "pagination")
PLAYER_FILE = r"[\"']file[\"']\s*:\s*[\"']([^\"']+\.(?:m3u8|mp4)[^\"']*)[\"']"
PLAYER_SETUP = r"jwplayer\s*\(\s*[\"'][^\"']*[\"']\s*\)\s*\.\s*setup\s*\(\s*(\{[\s\S]*?\})\s*\)\s*;"
MEDIA_URLS = (r"https?://[^\"'\s<>]+\.m3u8[^\"'\s<>]*", r"https?://[^\"'\s<>]+\.mp4[^\"'\s<>]*")
FRAME_SOURCE = r"<iframe[^>]+src=[\"']([^\"']+)[\"']"

MOST_PAGES = 50
SPACES = r"\s+"

# -- fixed values: filters, ranking, groups, readers ------------------------------
STATIC_FILES = r"\.(ico|png|svg|woff2?|css|js|ttf|eot)(\?|$)|favicon\.ico"
RANK_WORDS = "ver|watch|play|episodio|episode|capitulo|chapter|pelicula|movie|serie|anime|dragon|naruto|bleach|temporada|season|manga|descarg|download"
RANK_SKIP = "login|iniciar|regist|cuenta|perfil|discord|telegram|facebook|instagram|whatsapp|chat|cookie|privac"
GROUP_SKIP = "login|iniciar|regist|cuenta|discord|telegram|facebook|instagram|chat|cookie|privac|dmca"
READER_URL = "/chapter/|/reader/|/leer/|/capitulo/|/episodio/|/ver/"
READER_TEXT = "anterior|siguiente|prev|next|recargar|reload|download|descarg"
SERVER_WORDS = "server|servidor|opcion|mirror|source|cdn|host|calidad|quality|video|player"
CHALLENGE = "cloudflare|attention required|just a moment|checking your browser"
FAILING_RATE = 30
#: Elements that any site has: patterns for the text, the selector, and both together.
SKELETON_TEXT = (
    r"login|sign.?in|sign.?up|register|regist|iniciar\s*sesi|cerrar\s*sesi|logout|cuenta|account|perfil|profile|contrase|password|olvid|forgot",
    "discord|telegram|facebook|twitter|instagram|whatsapp|reddit|tiktok|youtube",
    "cookie|privac|dmca|terms|tos|condiciones|aceptar|rechazar",
)
SKELETON_SELECTOR = ("nav|menu|header|footer|sidebar|breadcrumb", r"^footer|\.footer")
SKELETON_BOTH = "language|idioma|lang|currency|moneda|region|pais"
RECOMMENDATIONS = (
    ("card-grid+search-input", "Catalogo detectado: usar filtro de busqueda para encontrar item"),
    ("episode-list", "Lista de episodios detectada: extraer y ordenar"),
    ("server-container", "Contenedores de servidores detectados: interactuar con tabs/botones"),
    ("video-player-server-container", "Reproductor detectado: extraer iframe directamente"),
    ("pagination", "Paginacion detectada: navegar paginas secuencialmente"),
    ("tabs", "Tabs detectados: clickear cada tab para revelar contenido"),
)
NO_RECOMMENDATION = "Estructura no reconocida: usar analisis manual de DOM"
#: (goal, pattern on texts or URLs, whether only URLs count, points), and the words of each goal.
GOAL_SIGNALS = (
    ("manga", "manga|manhwa|manhua", False, 25), ("manga", r"cap[ií]tulo|chapter|ch\.?\s*\d", False, 20), ("manga", "tomos|volumen|volume|tankobon|one.?shot|doujin", False, 15),
    ("manga", r"p[aá]gina\s*\d|page\s*\d", False, 10), ("manga", "/manga/|/capitulo/|/chapter/|/leer/|/read/|/reader/", True, 25),
    ("video", r"anime|episodio|episode|pel[ií]cula|movie|serie|hentai|dragon\s*ball|naruto|one\s*piece", False, 25), ("video", "episodio|episode|temporada|season|ova|ona|pelicula", False, 20),
    ("video", "/ver/|/episodio/|/episode/|/anime/", True, 25),
)
GOAL_WORDS = (
    ("image", "galer[ií]a|gallery|im[aá]genes|wallpaper|fanart|artwork|fotos", 30), ("download", "descarg|download|zip|rar|torrent|magnet|archivo|file", 25),
    ("document", "pdf|documento|document|libro|book|biblioteca|library|paper", 25),
)
GOAL_FILTERS = (
    ("manga", "manga|manhwa|manhua|cap[ií]tulo|chapter|tomos|leer|one.?shot|doujin"), ("image", "im[aá]gen|wallpaper|fanart|galer[ií]a|gallery|foto|artwork|scan|render"),
    ("download", "descarg|download|zip|rar|torrent|magnet|archivo|file|mediafire|mega"), ("document", "pdf|documento|document|libro|book|paper|biblioteca|library|leer|descarg"),
    ("video", "ver|watch|play|episodio|episode|capitulo|chapter|pelicula|movie|serie|anime|dragon|naruto|bleach|temporada|season"),
)
