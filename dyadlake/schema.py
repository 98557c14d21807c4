"""Names, weights and bounds that every operator generates its columns from."""

#: Event types of the interaction log, in the order of the count columns.
EVENT_TYPES = ["profile_view", "favorite", "poke", "image_reaction", "story_view", "story_reaction", "story_reply", "message", "message_reaction", "private_album_grant", "partner_request", "partner_accepted", "block", "report"]
#: Weights of the positive types in a preference signal.
POSITIVE_WEIGHTS = {"favorite": 1.5, "poke": 0.7, "image_reaction": 0.8, "story_reaction": 0.6, "story_reply": 1.0, "message": 1.2, "message_reaction": 0.5, "private_album_grant": 1.2, "partner_request": 1.5, "partner_accepted": 2.0}
PRIOR_WEIGHT, SATURATION = 2.0, 12.0
RECENT_DAYS = 30
#: Lower bounds and labels of half-open bands.
AGE_BANDS = [(25, "under_25"), (30, "25_29"), (35, "30_34"), (40, "35_39"), (45, "40_44"), (50, "45_49"), (60, "50_59"), (None, "60_plus")]
HEIGHT_BANDS = [(66, "under_66"), (70, "66_69"), (74, "70_73"), (None, "74_plus")]
WEIGHT_BANDS = [(150, "under_150"), (175, "150_174"), (200, "175_199"), (225, "200_224"), (250, "225_249"), (None, "250_plus")]
DISTANCE_BANDS = [(5, "under_5"), (15, "5_14"), (30, "15_29"), (60, "30_59"), (None, "60_plus")]
#: Inclusive search ranges; values outside have none.
AGE_RANGES = [(18, 24), (25, 29), (30, 39), (40, 49), (50, 59), (60, 69), (70, 80)]
HEIGHT_RANGES = [(48, 64), (65, 68), (69, 72), (73, 76), (77, 90)]
WEIGHT_RANGES = [(100, 149), (150, 199), (200, 249), (250, 299), (300, 350)]
#: Trait kinds with one value, and with several.
SINGLE_KINDS = ["age", "height", "weight", "distance", "position", "body_type", "relationship_status"]
MULTI_KINDS = ["body_hair", "type", "fetish"]
#: Targets and their weights in the composite score; the last two are risks.
TARGETS = ["favorite", "poke", "image_reaction", "story_engagement", "message_started", "reciprocal_message", "private_album_grant", "partner_accepted", "block", "report", "any_positive"]
SCORE_WEIGHTS = {"favorite": 0.8, "poke": 0.3, "image_reaction": 0.6, "story_engagement": 0.4, "message_started": 1.5, "reciprocal_message": 2.5, "private_album_grant": 0.4, "partner_accepted": 1.5}
RISK_WEIGHTS = {"block": 1.0, "report": 2.0}
#: Types whose counts say that a pair has history.
HISTORY_TYPES = ["profile_view", "favorite", "poke", "image_reaction", "story_view", "story_reaction", "story_reply", "message", "message_reaction"]
