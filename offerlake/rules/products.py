"""What in a title is a model number, and what only looks like one."""

MODEL_TOKEN = r"(?<![\w/])([A-Za-z0-9][A-Za-z0-9\-/.]{2,}[A-Za-z0-9])(?![\w])"
STYLE_CODE = r"\b([A-Z]{2}\d{4}-\d{3})\b"
SET_NUMBER = r"\b(\d{4,6})\b"
SPEC = (r"^(?:\d+(?:\.\d+)?(?:GB|TB|MB|GHZ|MHZ|HZ|W|V|MAH|WH|MM|CM|IN|INCH|FT|OZ|LB|LBS|CT|PK|PC|K|P|NM|QT|L|ML|G|KG|MP|X|FPS|MS|DB|AH|A|AMP|"
        r"HP|CC|BTU|GAL|PCS|PACK|PIECE|PIECES|COUNT|SERIES|GEN|TH|ND|RD|ST)|(?:19|20)\d\d|WIFI\d*|USB\w*|HDMI\d*|DDR\d|PCIE\d*|LTE|5G|4K|8K|M\d|"
        r"[A-Z]\d|BT\d*|I[3579]|R[3579]|RTX\d+|GTX\d+|RX\d+|IPX\d|IP\d\d|UHS\w*|V\d+|NVME|QHD|FHD|UHD)$")
WORDISH = """IN PORT PORTS PACK PK PIECE PIECES PC PCS WAY TIER LAYER SPEED BIT CORE GEN SERIES INCH FT OZ LB COUNT CT QT GAL CUP CUPS SET
SETS STAGE STEP BURNER DRAWER DOOR SEAT SEATER PERSON PLAYER SLICE SPEEDS MODE MODES IN1 INONE HOUR HR DAY YEAR YR MONTH AA AAA LAYERS
SIDED PLY GAUGE SHELF TIERS PANEL BAY BED BEDROOM LBS KG""".split()
SCREEN = (r"(\d{2,3}(?:\.\d)?)\s?(?:\"|”|″|''|-inch\b|\s?inch(?:es)?\b|-in\.?\b|\s?in\.?\s?(?:class|screen|display|monitor|tv|laptop))")
STORAGE = r"\b(\d{2,4})\s?(GB|TB)\b"
OUNCES = r"\b(\d{1,3}(?:\.\d+)?)\s?-?\s?(?:fl\.?\s?)?oz\b"
PACK = r"\b(\d{1,3})\s?-?\s?(?:pack|pk|ct|count|pc|pcs|piece)\b"
CONDITION = (r"\b(refurb(?:ished)?|renewed|open[- ]box|pre-?owned|used|certified refurbished|scratch (?:and|&) dent)\b")
BUNDLE = r"\bbundle\b|\bcombo\b|\bw/ (?:game|case|charger)|\bwith (?:\w+ )?(?:game|case)\b"
KIND = (r"\b(ink|toner|cartridges?|filters?|refills?|straps?|watch ?bands?|remotes?|mounts?|brackets?|sleeves?|skins?|screen protectors?|tips|"
        r"ear ?pads|replacement heads?|brush heads?|bulbs?|blades?|bags? for|batteries|battery packs?)\b")
ACCESSORY = (r"\b(?:compatible (?:with|for)|works with|fits|designed for|made for|replacement (?:for|parts?)|replacements?\b|for use with|"
             r"ink cartridges?|toner cartridges?|cartridges? for|refills?|(?:screen|lens) protectors?|remote control for|replacement remote|"
             r"ear ?pads|ear ?cushions|case for|cover for|protector for|charger for|cable for|stand for|mount for|holder for|skins? for|strap for|"
             r"band for|ear ?tips for|for (?:use with )?(?:apple |samsung |sony |google )?(?:iphone|ipad|airpods|galaxy|macbook|nintendo switch|"
             r"switch 2|ps5|xbox|pixel|apple watch))\b")
PREFIX_NOISE = (r"^(?:\[[^\]]*\]\s*|\$\S+\s*\|\s*|prime members?:\s*|refurb(?:ished)?\s+|open-box\s+|(?:\d+-(?:pk|pack|ct|pc|piece|count)|"
                r"\d+(?:\.\d+)?-?(?:oz|lb|ft|in)\.?|\d+\")\s+)+")

# Products known by a name instead of a number: pattern, brand, model ({0}: the first group).
NAMED = [
    (r"\bairpods pro 3\b", "Apple", "AIRPODSPRO3"),
    (r"\bairpods pro 2\b|\bairpods pro \(2nd gen", "Apple", "AIRPODSPRO2"),
    (r"\bairpods 4\b.*\b(?:anc|active noise)", "Apple", "AIRPODS4ANC"),
    (r"\bairpods 4\b", "Apple", "AIRPODS4"),
    (r"\bairpods max 2\b", "Apple", "AIRPODSMAX2"),
    (r"\bairpods max\b", "Apple", "AIRPODSMAX"),
    (r"\bapple watch ultra 3\b", "Apple", "WATCHULTRA3"),
    (r"\bapple watch ultra 2\b", "Apple", "WATCHULTRA2"),
    (r"\bapple watch series (\d{1,2})\b", "Apple", "WATCHS{0}"),
    (r"\bapple watch se 3\b|\bapple watch se \(3rd gen", "Apple", "WATCHSE3"),
    (r"\bmacbook air\b.*\b(m[1-6])\b", "Apple", "MACBOOKAIR{0}"),
    (r"\bmacbook pro\b.*\b(m[1-6](?: pro| max)?)\b", "Apple", "MACBOOKPRO{0}"),
    (r"\bnintendo switch 2\b", "Nintendo", "SWITCH2"),
    (r"\bnintendo switch oled\b", "Nintendo", "SWITCHOLED"),
    (r"\bmeta quest 3s\b", "Meta", "QUEST3S"),
    (r"\bmeta quest 3\b", "Meta", "QUEST3"),
    (r"\bsteam deck oled\b", "Valve", "STEAMDECKOLED"),
    (r"\bkindle paperwhite\b", "Amazon", "KINDLEPAPERWHITE"),
    (r"\bkindle colorsoft\b", "Amazon", "KINDLECOLORSOFT"),
    (r"\bkindle scribe\b", "Amazon", "KINDLESCRIBE"),
    (r"\bfire tv stick 4k max\b", "Amazon", "FIRETVSTICK4KMAX"),
    (r"\bfire tv stick 4k\b", "Amazon", "FIRETVSTICK4K"),
    (r"\becho dot\b.*\b(\d)(?:st|nd|rd|th) gen", "Amazon", "ECHODOT{0}"),
    (r"\bmx master 3s\b", "Logitech", "MXMASTER3S"),
    (r"\bmx master 4\b", "Logitech", "MXMASTER4"),
    (r"\bgalaxy s(\d{2}) ultra\b", "Samsung", "GALAXYS{0}ULTRA"),
    (r"\bgalaxy s(\d{2})\+", "Samsung", "GALAXYS{0}PLUS"),
    (r"\bgalaxy buds ?(\d) pro\b", "Samsung", "GALAXYBUDS{0}PRO"),
    (r"\bpixel (\d{1,2}) pro xl\b", "Google", "PIXEL{0}PROXL"),
    (r"\bpixel (\d{1,2}) pro\b", "Google", "PIXEL{0}PRO"),
    (r"\bpixel (\d{1,2})a\b", "Google", "PIXEL{0}A"),
    (r"\bpowerbeats pro 2\b", "Beats", "POWERBEATSPRO2"),
    (r"\bbeats studio pro\b", "Beats", "BEATSSTUDIOPRO"),
    (r"\bbeats solo 4\b", "Beats", "BEATSSOLO4"),
]
