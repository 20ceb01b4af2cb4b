"""Fixed schemas of the crawl table, its parse, and the site context."""

from __future__ import annotations

#: Characters of HTML that an excerpt holds, and what follows a longer page.
EXCERPT_CHARS = 12_000
TRUNCATED = "… [truncated]"

#: Response headers that a crawl keeps, and their columns.
HEADERS = {
    "Content-Encoding": "content_encoding",
    "Strict-Transport-Security": "strict_transport_security",
    "X-Content-Type-Options": "x_content_type_options",
    "X-Frame-Options": "x_frame_options",
    "Content-Security-Policy": "content_security_policy",
    "Cache-Control": "cache_control",
    "X-Robots-Tag": "x_robots_tag",
}

#: What a crawl delivers per URL, before parsing.
FETCHED = (
    "url string, status string, crawl_status string, mime_type string, crawl_time_s double, html string, "
    "redirect_target string, " + ", ".join(f"{c} string" for c in HEADERS.values())
)

#: Columns that come from parsing a whole page; '' or 0 where the page lacks them.
PAGE = (
    "title string, description string, h1 string, h_tags map<string,array<string>>, word_count int, "
    "heading_count int, image_count int, internal_links int, external_links int, link_to_word_ratio double, "
    "schema string, content_type string, canonical_url string, og_title string, og_description string, "
    "content_text string, links array<string>, image_urls array<string>, icon_urls array<string>, "
    "has_amphtml boolean, is_amp boolean, has_font_size boolean"
)

#: What the checks need from a page, or from its excerpt.
MARKUP = (
    "anchors array<struct<href:string,absolute:string,netloc:string,text:string,rel:string>>, "
    "images array<struct<src:string,absolute:string,netloc:string,alt:string,sized:boolean,loading:string>>, "
    "scripts array<struct<src:string,in_head:boolean,deferred:boolean>>, "
    "rels array<struct<rel:string,href:string,hreflang:string>>, "
    "metas array<struct<name:string,property:string,http_equiv:string,content:string>>, "
    "levels array<int>, actions array<string>, unlabelled boolean, n_tags int, n_requests int, lang string, "
    "has_breadcrumb boolean, jsonld_invalid boolean, nodes array<struct<types:array<string>,keys:array<string>>>, "
    "text string, body_text string"
)

SITE = (
    "robots_txt string, robots_txt_url string, sitemap_url string, sitemap_declared_in_robots boolean, "
    "sitemap_found boolean, sitemap_valid boolean, "
    "ssl_info struct<checked:boolean,not_after:timestamp,hostname_matches:boolean,expired:boolean>, "
    "favicon_url string, favicon_status int, external_links_truncated boolean, images_truncated boolean"
)
SITEMAP_URLS = "url string"
SITEMAP_HREFLANG = "url string, code string, href string"
LINK_PROBE = "url string, status int, redirected boolean, robots_blocked boolean"
IMAGE_PROBE = "url string, status int"
#: Field measurements of pages.
VITALS = "url string, metric string, value double"
