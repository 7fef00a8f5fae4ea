"""What counts as non-prose. Rules run in the order in which they stand."""

HTML_TAGS = """
html head body div span p a ul ol li dl dt dd table thead tbody tfoot tr td th h1 h2 h3 h4 h5 h6 header footer main nav section article aside
figure figcaption img picture video audio source canvas svg button input textarea select option optgroup label form fieldset legend b i u s em
strong small mark code pre kbd samp var blockquote q cite abbr address hr br wbr sub sup time details summary dialog menu caption col colgroup
iframe link meta style script title base object embed param track data output progress meter ruby rt rp bdi bdo del ins template slot map area
""".split()

CSS_PROPERTIES = """
color background background-color background-image background-position background-repeat background-size background-attachment background-clip
margin margin-top margin-right margin-bottom margin-left padding padding-top padding-right padding-bottom padding-left border border-top
border-right border-bottom border-left border-width border-style border-color border-radius border-collapse border-spacing outline outline-color
outline-style outline-width box-shadow box-sizing font font-family font-size font-weight font-style font-variant line-height letter-spacing
word-spacing text-align text-decoration text-transform text-indent text-overflow text-shadow white-space vertical-align direction writing-mode
display position top right bottom left float clear visibility overflow overflow-x overflow-y z-index opacity clip width height min-width
min-height max-width max-height flex flex-direction flex-wrap flex-flow flex-grow flex-shrink flex-basis justify-content align-items align-self
align-content order gap row-gap column-gap grid grid-template grid-template-columns grid-template-rows grid-column grid-row grid-area grid-gap
place-items place-content transform transform-origin transition transition-property transition-duration transition-timing-function
transition-delay animation animation-name animation-duration animation-timing-function animation-delay animation-iteration-count
animation-direction animation-fill-mode animation-play-state cursor content list-style list-style-type list-style-position list-style-image
table-layout caption-side empty-cells pointer-events user-select object-fit object-position fill stroke stroke-width filter backdrop-filter
mix-blend-mode will-change resize appearance accent-color caret-color
""".split()

#: Default rules: a pattern, or None for a rule over lines (operators/prose.py).
DEFAULT = (
    ("yaml_front_matter", r"(?s)\A---[ \t]*\n.*?\n---[ \t]*(?:\n|\Z)"),
    ("html_block", r"(?is)<!--.*?-->|<\s*(style|script|svg|noscript)\b[^>]*>.*?</\s*\1\s*>"),
    ("fenced_code", r"(?ms)^```[^\n]*\n.*?^```[ \t]*$|```.*?```"),
    ("indented_code", None),
    ("inline_code", r"`[^`\n]+`"),
    ("css_at_rule", None),
    ("css_rule_block", None),
    ("html_tag", r"</?(?!https?://|mailto:)[A-Za-z][A-Za-z0-9:-]*(?:\s+[^<>]*?)?/?>"),
    ("json_block", None),
    ("ascii_table", None),
)
#: Rules on request; of a link its text stays.
AGGRESSIVE = (
    ("markdown_image", r"(?m)^\s*!\[[^\]]*\]\([^)]+\)\s*$"),
    ("markdown_link_url", r"\[([^\]\n]+)\]\((?:https?://|mailto:)[^)]+\)"),
    ("autolink_url", r"<(?:https?://|mailto:)[^>\s]+>"),
    ("bare_url", r"(?m)^\s*(?:https?://|mailto:)\S+\s*$|(?:https?://)\S+"),
    ("footnote_marker", r"\[\^[^\]]+\]"),
    ("inline_citation", r"\[(?:[A-Z][A-Za-z-]+(?:\s+and\s+[A-Z][A-Za-z-]+)?\s+)?\d{4}[a-z]?\]|\([A-Z][A-Za-z-]+(?:\s+(?:and|&)\s+[A-Z][A-Za-z-]+)?,\s+\d{4}[a-z]?\)"),
)
#: Prose that is not the writer's own.
MASKING = (
    ("markdown_heading", r"(?m)^[ \t]{0,3}#{1,6}[ \t]+[^\n]+|^[^\n]+\n[=-]{3,}[ \t]*$"),
    ("block_quote", r"(?m)(?:^[ \t]{0,3}>[^\n]*\n?)+"),
    ("long_inline_quotation", r'["“][^"”\n]{50,}["”]'),
    ("statutory_citation", r"\b(?:\d+\s+U\.?\s*S\.?\s*C\.?\s*§+\s*\d+(?:[A-Za-z]+)?(?:\([a-zA-Z0-9]+\))*|Pub\.\s*L\.\s*No\.\s*\d+[-–]\d+|Fed\.\s*R\.\s*(?:Civ|Crim|App|Evid|Bankr)\.\s*P\.\s*\d+|§+\s*\d+(?:\.\d+)*(?:\([a-zA-Z0-9]+\))*|[A-Z][A-Za-z\-']+\s+v\.\s+[A-Z][A-Za-z\-']+(?:,\s*\d+\s+[A-Z][A-Za-z\.]+\s+\d+)?)"),
    ("llm_wrapper_phrase", r"(?im)(?:^|\n)[ \t]*(?:As an AI(?:\s+language\s+model)?[^.\n]*\.?|I(?:'m|\s+am)?\s+(?:an?\s+)?(?:AI|language\s+model)[^.\n]*\.?|I\s+cannot[^.\n]*(?:provide|create|assist|help|generate)[^.\n]*\.?|I(?:'m|\s+am)\s+(?:not\s+able\s+to|unable\s+to)[^.\n]*\.?|I\s+hope\s+this\s+helps[!.]?|Let\s+me\s+know\s+if[^.\n]*\.?|Please\s+(?:let\s+me\s+know|feel\s+free)[^.\n]*\.?)"),
    ("prompt_remnant", r"(?im)\A[ \t]*(?:Please\s+(?:write|create|generate|draft|compose)[^.\n]*\.?\s*|Write\s+(?:a|an|the)\s+\w+[^.\n]*\.?\s*|You\s+are\s+(?:a|an)\s+\w+[^.\n]*\.?\s*|Act\s+as\s+(?:a|an)\s+\w+[^.\n]*\.?\s*|System:\s*[^\n]*\n?)"),
)
PROFILES = {
    "none": (),
    "prose_body_only": ("markdown_heading", "block_quote", "long_inline_quotation", "statutory_citation"),
    "exclude_quotations": ("block_quote", "long_inline_quotation"),
    "exclude_headings": ("markdown_heading",),
    "prose_strict": ("markdown_heading", "block_quote", "long_inline_quotation", "statutory_citation", "llm_wrapper_phrase", "prompt_remnant"),
}

CSS_AT = r"(?i)^\s*@(media|keyframes|import|supports|font-face|charset|page|layer)\b"
CSS_OPEN = r"""^\s*[\.\#\&\*\>\+A-Za-z][\w\-\.\#\:\,\s\>\+\&\*\[\]="']*\s*\{"""
CSS_DECLARATION = r"^-?[A-Za-z][\w-]*\s*:\s*[^;{}]+$"
JSON_KEY = r'^\s*"[^"\n]+"\s*:'
TABLE_ROW = r"^\s*\|.+\|\s*$"
TABLE_RULE = r"^\s*\+(?:[-=]+\+)+\s*$|^\s*\|[\s\-:|]+\|\s*$"
TABLE_LINE = r"^\s*(?:\|.+\|\s*|\+(?:[-=]+|\s*)\+.*)$"
INDENTED = r"^(?: {4,}|\t)\S"
#: Lines that a block may take, and from which share of stripped words on a text is doubtful or failed.
BLOCK_LINES = {"css_at_rule": 80, "css_rule_block": 50, "json_block": 200}
WARN, FAIL = 0.01, 0.05
