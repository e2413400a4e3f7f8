"""Pages with media: the test tables' pages, each with a fragment of players, cards, lists and the like, by its number.

The tables' own pages hold links, headings and text only; the fragments give
every scan something to find.  Fixed text, so results can be checked by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fragments by page number modulo their count; {} stands for the page's number.
FRAGMENTS = (
    '<div class="player-box"><iframe src="https://embed.host1.com/e/{}" id="p"></iframe><button>Server 1</button><button role="tab">Opcion 2</button></div><video src="https://cdn.host1.com/v{}.mp4"></video>',
    '<div class="grid"><div class="card item" data-item=\'{"id": {}}\'><a class="title" href="/ver/a{}">Naruto {}</a><img data-src="https://img.host2.com/{}.jpg" src="lazy.gif"></div><div class="card item" data-item="raw {}"><a class="title" href="/ver/b{}">Boruto</a></div><div class="card item"><a class="title" href="/ver/c{}">Bleach</a></div><div class="card item"><a class="title" href="/ver/d{}">Dragon</a></div></div><input type="search" id="search-box" placeholder="Buscar">',
    '<div class="pagination"><a href="?page=1" class="current">1</a><a href="?page=2">2</a><a href="?page=3">siguiente</a></div><div class="filters"><select id="genre"></select><input type="checkbox"><button>Filtrar</button></div>',
    '<div role="tablist" class="tabs main"><a role="tab" href="#1">Latino</a><a role="tab" href="#2">English</a></div><div style="background-image: url(\'https://img.host3.com/bg{}.png\')"></div>',
    '<ul class="episodios"><li><a class="epi" href="/ver/x-{}-1">Episodio 1</a></li><li><a class="epi" href="/ver/x-{}-2">Episodio 2</a></li><li><a class="epi" href="/ver/x-{}-3">Episodio 3</a></li></ul><button class="btn-descarga" onclick="go(\'https://mega.host4.com/file/{}\')">Descargar</button>',
    '<div itemscope itemtype="https://schema.org/Movie"><span itemprop="name">Film {}</span><meta itemprop="year" content="19{}"></div><script type="application/ld+json">{"@type": "Movie", "n": {}}</script><ul id="player"><li><b data-key="name">Uno {}</b><b data-key="lang">ES</b></li><li>Dos</li></ul><p data-global="site">Host5</p>',
    '<select><option value="">Cargar imagenes: 1</option><option value="-6-1.html">6 imagenes</option><option value="-10-1.html">10 imagenes</option></select><select class="sl-page"><option value="/r/{}-10-1.html">1/2</option><option value="/r/{}-10-2.html">2/2</option></select><a href="/r/next">Siguiente</a>',
    '<script>jwplayer("p").setup({sources: [{file: "https://cdn.host7.com/{}/low.m3u8", label: "360p"}, {file: "https://cdn.host7.com/{}/high.m3u8", label: "1080p"}]});</script><div class="reproductor-wrapper"><iframe src="//embed.host7.com/e/{}"></iframe></div>',
)
_PATHS = ("ver", "catalogo", "directory", "watch", "anime", "pelicula", "chapter", "player")


def _filled(text: str) -> Column:
    parts = text.split("{}")
    return F.concat(*(x for p in parts[:-1] for x in (F.lit(p), F.col("page_id").cast("string"))), F.lit(parts[-1]))


def _chosen(options: tuple[str, ...], of) -> Column:
    out = F.lit(None).cast("string")
    for i, x in enumerate(options):
        out = F.when(F.col("page_id") % len(options) == i, of(x)).otherwise(out)
    return out


def media_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html)."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    url = F.concat(F.lit("https://host"), (F.col("page_id") % 5).cast("string"), F.lit(".com/"), _chosen(_PATHS, F.lit), F.lit("/"), F.col("page_id").cast("string"))
    return pages.select("page_id", url.alias("url"), F.concat("html", _chosen(FRAGMENTS, _filled)).alias("html"))


def embed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, html): pages behind the media pages' frames: some lead on to another frame, some in a circle, one in four to a file; one in five is missing."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id")
    n = F.col("page_id").cast("string")
    first = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit('<script>var player = {"file": "https://cdn.host1.com/'), n, F.lit('.m3u8"};</script>')))
    first = first.when(F.col("page_id") % 4 == 1, F.concat(F.lit('<iframe src="https://second.host1.com/e/'), n, F.lit('"></iframe>')))
    first = first.when(F.col("page_id") % 4 == 2, F.concat(F.lit('<iframe src="https://embed.host1.com/e/'), (F.col("page_id") + 4).cast("string"), F.lit('"></iframe>'))).otherwise(F.lit("<p>nothing</p>"))
    one = rows.where(F.col("page_id") % 5 != 3).select(F.concat(F.lit("https://embed.host1.com/e/"), n).alias("url"), first.alias("html"))
    two = rows.select(F.concat(F.lit("https://second.host1.com/e/"), n).alias("url"), F.concat(F.lit("<video><source src='https://cdn.host2.com/"), n, F.lit(".mp4?x=1'></video>")).alias("html"))
    return one.unionByName(two)
