from .amounts import fn_money, fn_pct
from .geo import Grid, fn_haversine
from .scores import (badge_size, fn_basis_weight, sc_local, sc_online, sc_regular, sc_sale_rank, sc_top_rank)
from .text import (fn_clean, fn_fold, fn_host, fn_hosts, fn_norm, fn_offer_words, fn_overlap, fn_phrase_near,
                   fn_product_ids, fn_site_key, fn_tidy, fn_words)
from .times import fn_ad_end_local, fn_ad_start_local, fn_nearest_year
from .wording import fn_summary, tm_text
