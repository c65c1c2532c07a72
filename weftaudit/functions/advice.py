"""Fixed texts of the recommendation rules."""

from __future__ import annotations

# Severity order and anchor texts that say nothing.
SEVERITIES = ["Critical", "High", "Medium", "Low"]
VAGUE_ANCHORS = ["click here", "here", "read more", "learn more", "more"]

# Places and steps that several rules share.
_TITLE_PLACE = "In your HTML <head> section, replace the existing <title> tag (or add one before </head>)"
_TITLE_STEPS = {
    "wordpress": "Dashboard → Pages → Edit page → SEO settings or theme header → paste the suggested title in the SEO/Page Title field.",
    "squarespace": "Pages → Select page → Settings → SEO → SEO Title → paste the suggested title.",
    "wix": "Menus & Pages → Select page → SEO Basics → Title tag → paste the suggested title.",
    "shopify": "Online Store → Pages/Products/Collections → Search engine listing preview → Edit website SEO → Page title.",
    "generic": "Open the page template or HTML file and replace the existing <title> tag inside the <head> section with the suggested version.",
}
_META_PLACE = 'Add this inside your <head>: <meta name="description" content="[YOUR TEXT HERE]">'
_META_STEPS = {
    "wordpress": "Dashboard → Pages → Edit page → SEO plugin settings → Meta Description field.",
    "squarespace": "Pages → Select page → Settings → SEO → SEO Description.",
    "wix": "Menus & Pages → Select page → SEO Basics → Meta description.",
    "shopify": "Online Store → Pages/Products/Collections → Search engine listing preview → Edit website SEO → Description.",
    "generic": "Open the page template or HTML file and add or replace the meta description inside the <head> section.",
}
_H1_PLACE = "Place the <h1> tag as the first heading in your page's main content area (<main> or first <div>)"

# Per rule the pillar, element, reason, placement, impact and platform steps.
RULES = {
    "title_missing": {
        "pillar": "on_page_seo", "element": "title tag", "impact": "High",
        "why": "The title tag is what people see in search results and browser tabs. Without it, search engines and visitors have less context about the page.",
        "place": _TITLE_PLACE,
        "steps": {**_TITLE_STEPS, "generic": "Open the page template or HTML file and add the suggested <title> tag inside the <head> section."},
    },
    "title_long": {
        "pillar": "on_page_seo", "element": "title tag", "impact": "Medium",
        "why": "Very long title tags often get cut off in search results, which makes your page look incomplete and can lower clicks.",
        "place": _TITLE_PLACE, "steps": _TITLE_STEPS,
    },
    "title_short": {
        "pillar": "on_page_seo", "element": "title tag", "impact": "Medium",
        "why": "A very short title does not give search engines or visitors enough detail about the page topic.",
        "place": _TITLE_PLACE, "steps": _TITLE_STEPS,
    },
    "title_keyword": {
        "pillar": "on_page_seo", "element": "title tag", "impact": "Medium",
        "why": "Including the main page topic in the title helps search engines match the page to relevant searches.",
        "place": _TITLE_PLACE, "steps": _TITLE_STEPS,
    },
    "meta_missing": {
        "pillar": "on_page_seo", "element": "meta description", "impact": "High",
        "why": "The meta description is usually the short summary people read in search results before deciding whether to click.",
        "place": _META_PLACE, "steps": _META_STEPS,
    },
    "meta_length": {
        "pillar": "on_page_seo", "element": "meta description", "impact": "Medium",
        "why": "Meta descriptions that are too short or too long can lower click-through rates because search engines may rewrite or cut them off.",
        "place": _META_PLACE, "steps": _META_STEPS,
    },
    "h1_missing": {
        "pillar": "on_page_seo", "element": "H1", "impact": "High",
        "why": "Your H1 is the main headline for the page. It helps visitors and search engines understand the page topic right away.",
        "place": _H1_PLACE,
        "steps": {
            "wordpress": "Dashboard → Pages → Edit page → add a Heading block at the top of the main content → set it to H1.",
            "squarespace": "Edit page → add or select the top text block → set the format to Heading 1.",
            "wix": "Edit page → select the top heading element → Change Heading Type → H1, or add a new heading at the top.",
            "shopify": "Online Store → Themes → Customize or edit page template → add the suggested H1 at the top of the main content.",
            "generic": "Edit the page content or template and insert the suggested H1 as the first visible heading in the main content area.",
        },
    },
    "h1_many": {
        "pillar": "on_page_seo", "element": "H1", "impact": "High",
        "why": "Using more than one H1 makes it harder for search engines to tell which headline is the main topic of the page.",
        "place": _H1_PLACE,
        "steps": {
            "wordpress": "Edit the page → select each extra Heading block → change its level from H1 to H2.",
            "squarespace": "Edit the page → click each extra Heading 1 block → change it to Heading 2.",
            "wix": "Edit the page → select each extra heading → Change Heading Type from H1 to H2.",
            "shopify": "Edit the page or theme section → keep one H1 only and change the others to H2 in the section settings or template code.",
            "generic": "Keep the first main heading as H1, then edit every other H1 in the HTML or editor and change it to H2.",
        },
    },
    "image_alt": {
        "pillar": "ux_design", "element": "image alt", "impact": "Medium",
        "why": "Alt text helps people using screen readers understand images, and it also gives search engines more context about the page.",
        "place": 'In the img tag, add: alt="[YOUR SUGGESTED TEXT]"',
        "steps": {
            "wordpress": "Media Library → Edit image → Alt Text field.",
            "squarespace": "Image block → Edit → Accessibility Tab → Alt Text.",
            "wix": "Click image → Settings → What’s in the image? (Alt Text) → paste the suggested text.",
            "shopify": "Online Store → Themes/Products → open the image settings or HTML → add the suggested alt text.",
            "generic": "Edit the HTML for the image and add the suggested alt attribute inside the <img> tag.",
        },
    },
    "anchor_text": {
        "pillar": "links_architecture", "element": "anchor text", "impact": "Medium",
        "why": "Descriptive link text tells readers and search engines what the destination page is about before they click.",
        "place": "Replace the visible text between the opening <a> and closing </a> tags with the suggested anchor text.",
        "steps": {
            "wordpress": "Edit the page → click the link text → replace the words shown to visitors.",
            "squarespace": "Edit the text block → highlight the link text → replace it with the suggested descriptive wording.",
            "wix": "Edit the text element containing the link → replace the linked words with the suggested text.",
            "shopify": "Edit the page, product, or blog content → update the linked words to the suggested anchor text.",
            "generic": "Edit the link in your HTML or page editor and replace the visible link text with the suggested text.",
        },
    },
    "broken_links": {
        "pillar": "technical_seo", "element": "broken links", "impact": "High",
        "why": "Broken links frustrate visitors and can reduce trust, conversions, and search engine quality signals.",
        "place": "Edit each affected <a> tag and replace the href value with a working destination URL.",
        "steps": {
            "wordpress": "Edit the page → click each broken link → replace the URL in the link settings.",
            "squarespace": "Edit page → click the linked text or button → update the URL destination.",
            "wix": "Edit the page → select the linked text/button → Change Link → paste the correct URL.",
            "shopify": "Edit the page/product/blog content → update each broken link URL in the editor.",
            "generic": "Open the page HTML or editor, find each broken link URL, and replace it with a working URL or remove the link.",
        },
    },
    "thin_content": {
        "pillar": "content_quality", "element": "body content", "impact": "Medium",
        "why": "Thin content gives visitors less value and gives search engines less context about what your page should rank for.",
        "place": "Add the extra content inside the main body area of the page, ideally below the opening section and above the footer.",
        "steps": {
            "wordpress": "Dashboard → Pages/Posts → Edit → add more paragraph blocks in the main content area.",
            "squarespace": "Edit page → open the main text block → add more body copy and supporting sections.",
            "wix": "Edit page → select the main text area → add more body copy, FAQs, or sections.",
            "shopify": "Edit the page, product description, or blog post and add more helpful body content in the main editor.",
            "generic": "Edit the main page content and expand the body copy with the suggested sections.",
        },
    },
    "stuffing": {
        "pillar": "content_quality", "element": "body content", "impact": "Medium",
        "why": "Repeating the same keyword too often can make the content sound unnatural and may look manipulative to search engines.",
        "place": "Edit the sentences in the body copy where the keyword repeats too often and rewrite them more naturally.",
        "steps": {
            "wordpress": "Edit the page/post content and rewrite the listed sentences in the block editor.",
            "squarespace": "Edit the text block containing the repeated keyword and rewrite the listed sentences.",
            "wix": "Open the page text element and rewrite the listed sentences with more natural wording.",
            "shopify": "Edit the page, product description, or blog post body copy and rewrite the listed sentences.",
            "generic": "Open the page content and rewrite the listed sentences so the keyword appears less often.",
        },
    },
    "viewport": {
        "pillar": "technical_seo", "element": "viewport meta", "impact": "Medium",
        "why": "Without a viewport tag, pages can display poorly on phones and tablets, which hurts mobile usability and SEO.",
        "place": 'Add this inside your <head>: <meta name="viewport" content="width=device-width, initial-scale=1">',
        "steps": {
            "wordpress": "Appearance → Theme File Editor or your theme settings → header.php → add the viewport meta tag inside <head>.",
            "squarespace": "Settings → Advanced → Code Injection → Header, or use the site header settings if available.",
            "wix": "Use the site custom code area or SEO settings to ensure the viewport tag is present in the page head.",
            "shopify": "Online Store → Themes → Edit code → theme.liquid → add the viewport meta tag inside <head>.",
            "generic": "Open the HTML template for the page and add the viewport meta tag inside the <head> section.",
        },
    },
    "https": {
        "pillar": "technical_seo", "element": "HTTPS", "impact": "High",
        "why": "HTTPS protects visitor data and is a trust and ranking signal for search engines.",
        "place": "Apply the redirect at the server, CDN, hosting dashboard, or domain routing level so every HTTP request permanently redirects to HTTPS.",
        "steps": {
            "wordpress": "Dashboard → Settings → General → update WordPress Address and Site Address to https://, then force HTTPS in hosting or via a redirect plugin.",
            "squarespace": "Squarespace-managed domains usually use SSL automatically; in Settings → Domains, ensure SSL is active and primary URLs use https.",
            "wix": "SSL is automatic on Wix. Make sure your connected domain resolves to the secure site URL and update any hardcoded http:// links.",
            "shopify": "SSL is automatic on Shopify. Ensure your primary domain is active and update any hardcoded http:// links in themes or content.",
            "generic": "Enable SSL, then add a 301 redirect rule from http:// to https:// at the server or hosting level.",
        },
    },
    "robots": {
        "pillar": "technical_seo", "element": "robots.txt", "impact": "High",
        "why": "A robots.txt file helps search engines understand where they can crawl and where your sitemap lives.",
        "place": "Create a plain-text file named robots.txt in the root of your domain so it loads at /robots.txt.",
        "steps": {
            "wordpress": "Use an SEO plugin's robots.txt editor or upload a robots.txt file to the site root via hosting/File Manager.",
            "squarespace": "Squarespace controls robots.txt automatically; if it is missing, check domain routing and platform settings or use custom files only if supported.",
            "wix": "Wix generates robots.txt automatically. If missing, review SEO settings and domain connection, then contact Wix support if the file does not load.",
            "shopify": "Shopify manages robots.txt, but you can customize robots.txt.liquid in supported themes and include the suggested sitemap line if needed.",
            "generic": "Create a new robots.txt file at your web root and paste the suggested content into it.",
        },
    },
    "sitemap": {
        "pillar": "technical_seo", "element": "XML sitemap", "impact": "High",
        "why": "A sitemap helps search engines discover and recrawl your important pages more efficiently.",
        "place": "Generate the sitemap through your CMS or SEO tool, then make sure it is publicly available at /sitemap.xml and referenced in robots.txt.",
        "steps": {
            "wordpress": "Install or enable Yoast SEO, Rank Math, or a similar plugin, then confirm the sitemap URL and submit it in Google Search Console.",
            "squarespace": "Squarespace usually auto-generates /sitemap.xml. If missing, verify indexing settings and your connected domain.",
            "wix": "Wix auto-generates a sitemap. If it is missing, check SEO settings and confirm the site is published on the connected domain.",
            "shopify": "Shopify auto-generates sitemaps. If missing, confirm the primary domain is connected and the storefront is live.",
            "generic": "Use your CMS, build process, or SEO tool to generate sitemap.xml, upload it to the site root, and reference it in robots.txt.",
        },
    },
}

# Remaining texts of single rules.
VIEWPORT_FIX = '<meta name="viewport" content="width=device-width, initial-scale=1">'
H1_MANY_FIX = "Change all H1 tags except the first one to H2."
BROKEN_FIX = (
    'Update each broken <a href="..."> link to the correct live URL, or remove the link entirely '
    "if no replacement page exists."
)
THIN_FIX_TAIL = "Consider adding: a brief intro, 2-3 key points, FAQ section, or conclusion."
STUFFING_FIX_TAIL = ". Replace repeated uses with natural variations, pronouns, or shorter phrasing."
HTTPS_FIX = "Redirect all http:// URLs to https:// via your hosting provider or a redirect rule"
META_FILLER = " Trusted guidance for visitors and search engines."
DEFAULT_CALL = "Contact us today"
