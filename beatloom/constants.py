"""Fixed values.

Every word list, lookup table, threshold and text in this module has to equal the
published behaviour for results to agree, so they are stated plainly here.
"""

# --- fixed values: the closed set of lanes ---------------------------------------
LANES = [
    "kick", "snare", "hihat_closed", "hihat_open", "tom_low", "tom_mid", "tom_high",
    "crash", "ride", "clap", "percussion",
]
FOCUSED_LANES = ["kick", "snare", "hihat_closed"]
BACKBONE_LANES = ["kick", "snare"]
ACCENT_LANES = ["crash", "ride"]
HAT_LANES = ["hihat_closed", "hihat_open"]
TOM_LANES = ["tom_high", "tom_mid", "tom_low"]

# --- fixed values: label aliases per lane, by map version -------------------------
LANE_ALIASES = {
    "runtime": {
        "kick": ["kick", "bd", "bass_drum", "bassdrum", "bass_drum_1", "bass_drum_2", "bassdrum_1", "bassdrum_2", "kik", "kick_drum"],
        "snare": ["snare", "sd", "sn", "rimshot", "rim", "cross_stick", "side_stick", "sidestick"],
        "hihat_closed": [
            "hihat_closed", "closed_hihat", "closed_hat", "closed_hi_hat", "hhc", "hat_closed", "hi_hat_closed", "chh", "hh",
            "hihat",
        ],
        "hihat_open": ["hihat_open", "open_hihat", "open_hat", "open_hi_hat", "hho", "hat_open", "hi_hat_open", "ohh"],
        "tom_low": [
            "tom_low", "low_tom", "floor_tom", "floortom", "floor_tom_low", "low_floor_tom", "high_floor_tom", "tom_3",
            "floor_tom_1",
        ],
        "tom_mid": ["tom_mid", "mid_tom", "middle_tom", "mid_tom_1", "mid_tom_2", "tom_medium", "tom_2", "center_tom", "middle_rack_tom"],
        "tom_high": ["tom_high", "high_tom", "rack_tom", "racktom", "rack_tom_1", "rack_tom_2", "high_rack_tom", "tom_1"],
        "crash": ["crash", "crash_cymbal", "crash_left", "crash_right", "crash_1", "crash_2", "china"],
        "ride": ["ride", "ride_cymbal", "ride_bell", "ride_1", "ride_2"],
        "clap": ["clap", "handclap", "hand_clap"],
        "percussion": ["percussion", "perc", "cowbell", "shaker", "tambourine"],
    },
    "audit": {
        "kick": [
            "kick", "bd", "bass_drum", "bassdrum", "bass_drum_1", "bass_drum_2", "bassdrum_1", "bassdrum_2", "kik", "kick_drum",
            "kickdrum", "surdo",
        ],
        "snare": [
            "snare", "sd", "sn", "rimshot", "rim", "cross_stick", "side_stick", "sidestick", "snare_drum", "snaredrum",
            "rim_shot", "vibraslap", "claves", "castanets", "short_guiro", "guiro_short", "mute_cuica", "cuica_mute",
            "wood_block", "woodblock", "high_wood_block", "highwood_block",
        ],
        "hihat_closed": [
            "hihat_closed", "closed_hihat", "closed_hat", "closed_hi_hat", "hhc", "hat_closed", "hi_hat_closed", "chh", "hh",
            "hihat", "closed_hi_hat_edge", "tight_hihat", "tight_hi_hat", "pedal_hihat", "pedal_hi_hat", "cowbell", "shaker",
            "tambourine", "cabasa", "maracas", "short_whistle", "whistle_short", "high_agogo", "agogo_high", "sleigh_bells",
            "bell_tree", "mute_triangle", "triangle_mute",
        ],
        "hihat_open": [
            "hihat_open", "open_hihat", "open_hat", "open_hi_hat", "hho", "hat_open", "hi_hat_open", "ohh", "half_open_hihat",
            "half_open_hi_hat", "open_hi_hat_edge", "long_whistle", "whistle_long", "long_guiro", "guiro_long", "open_triangle",
            "triangle_open",
        ],
        "tom_low": [
            "tom_low", "low_tom", "floor_tom", "floortom", "low_floor_tom", "floor_tom_1", "floor_tom_2", "tom_3", "low_bongo",
            "bongo_low", "low_conga", "conga_low", "low_timbale", "timbale_low", "low_wood_block", "lowwood_block",
            "woodblock_low", "lowwoodblock",
        ],
        "tom_mid": [
            "tom_mid", "mid_tom", "middle_tom", "mid_tom_1", "mid_tom_2", "tom_medium", "medium_tom", "rack_tom_2", "tom_2",
            "low_mid_tom", "lowmid_tom", "hi_mid_tom", "himid_tom", "low_agogo", "agogo_low", "open_cuica", "cuica_open",
        ],
        "tom_high": [
            "tom_high", "high_tom", "rack_tom", "racktom", "high_rack_tom", "rack_tom_1", "tom_1", "high_floor_tom",
            "high_bongo", "bongo_high", "mute_high_conga", "conga_mute_high", "open_high_conga", "conga_open_high",
            "high_conga", "conga_high", "high_timbale", "timbale_high",
        ],
        "crash": [
            "crash", "crash_cymbal", "crash_left", "crash_right", "crash_1", "crash_2", "china", "china_cymbal", "splash",
            "splash_cymbal", "chinese_cymbal",
        ],
        "ride": ["ride", "ride_cymbal", "ride_bell", "ride_1", "ride_2"],
        "clap": ["clap", "handclap", "hand_clap"],
        "percussion": ["percussion", "perc"],
    },
}

# --- fixed values: note numbers per lane, by map version --------------------------
MIDI_LANES = {
    "runtime": {
        "kick": [35, 36], "snare": [37, 38, 40], "hihat_closed": [42, 44], "hihat_open": [46],
        "tom_low": [41, 43], "tom_mid": [45], "tom_high": [47, 48, 50], "crash": [49, 52, 55, 57],
        "ride": [51, 53, 59], "clap": [39], "percussion": [54, 56, 58, 60, 82, 83],
    },
    "audit": {
        "kick": [35, 36], "snare": [37, 38, 40, 68, 69],
        "hihat_closed": [42, 44, 58, 65, 66, 67, 75, 76, 77], "hihat_open": [46],
        "tom_low": [41, 43, 62, 64], "tom_mid": [45, 56, 70], "tom_high": [47, 48, 50, 54, 60, 61, 63, 71],
        "crash": [49, 52, 55, 57, 72, 73, 74], "ride": [51, 53, 59], "clap": [39],
        "percussion": [78, 79, 80, 81, 82, 83],
    },
}
# note number -> plain label used by the transcription adapters (map version "adtof")
MIDI_LABELS = {
    "kick": [35, 36], "snare": [37, 38, 40], "clap": [39], "floor tom": [41, 43], "closed hi hat": [42, 44],
    "mid tom": [45], "open hi hat": [46], "high tom": [47, 48, 50], "crash": [49, 52, 55, 57],
    "ride": [51, 53, 59], "percussion": [60],
}

# --- fixed values: lane -> (game lane, colour, key) -------------------------------
GAME_LANES = {
    "kick": (4, "purple", "space"), "snare": (0, "red", "d"), "clap": (0, "red", "d"),
    "hihat_closed": (1, "yellow", "f"), "hihat_open": (3, "green", "k"), "tom_high": (2, "blue", "j"),
    "tom_mid": (3, "green", "k"), "tom_low": (3, "green", "k"), "crash": (3, "green", "k"),
    "ride": (3, "green", "k"), "percussion": (3, "green", "k"),
}

# --- fixed values: content type by file extension ---------------------------------
CONTENT_TYPES = {
    "wav": "audio/wav", "mp3": "audio/mpeg", "m4a": "audio/mp4", "aac": "audio/aac", "aiff": "audio/aiff",
    "aif": "audio/aiff", "caf": "audio/x-caf", "flac": "audio/flac",
}

# --- fixed values: timing and grid -------------------------------------------------
TICKS_PER_BEAT = 480
BEATS_PER_BAR = 4
DEFAULT_TEMPO = 120.0
DEFAULT_SUBDIVISIONS = 4
MAX_SUBDIVISIONS = 12
SUBDIVISION_CANDIDATES = [3, 4, 6, 8, 12, 16, 24]
TIME_TOLERANCE = 0.0005
LOOP_SNAP_SECONDS = 0.03
LOOP_SNAP_BEAT_SHARE = 0.08
BACKBONE_OVERRIDE = 0.2
ONSET_MATCH_TOLERANCE = 0.05

# --- fixed values: sample analysis ---------------------------------------------------
SAMPLE_RATE = 22050
FRAME_SIZE = 1024
HOP_SIZE = 512
MIN_EVENT_GAP = 0.07
MAX_EVENT_GAP = 1.5
LANE_MIN_GAP = {"kick": 0.075, "snare": 0.10, "closed_hihat": 0.055, "open_hihat": 0.08, "crash": 0.16}
DEFAULT_LANE_GAP = 0.14
SNARE_FLOOR = 0.54
HAT_FLOOR = 0.62
ISOLATED_HAT_FLOOR = 0.78
BEAT_WINDOW = 0.16
UPBEAT_WINDOW = 0.12
KICK_PROMOTION_FLOOR = 0.7
KICK_PROMOTION_SHARE = 0.32

# --- fixed values: loose payload keys ------------------------------------------------
BEAT_KEYS = ["beats", "beatTimes", "beat_times"]
DOWNBEAT_KEYS = ["downbeats", "downbeatTimes", "downbeat_times"]
SUBDIVISION_KEYS = [
    "subdivisions", "subdivisionTimes", "subdivision_times", "tatums", "tatumTimes", "tatum_times",
]
HIT_PATHS = [
    "drumEvents", "drum_events", "drumEventCandidates", "drum_event_candidates", "events", "hits", "notes",
    "candidates", "drums.events", "drums.hits", "drums.candidates", "percussion.events", "percussion.hits",
    "percussion.candidates", "timing.drumEvents", "timing.drum_events", "timing.events", "tracks", "instruments",
    "predictions", "detections", "transcription.events", "transcription.hits",
]
HIT_CHILD_KEYS = [
    "items", "events", "hits", "notes", "candidates", "drumEvents", "drum_events", "tracks", "instruments",
    "predictions", "detections", "children",
]
ONSET_KEYS = [
    "onsetSeconds", "onset_seconds", "time", "timestamp", "timeSeconds", "time_seconds", "startSeconds",
    "start_seconds", "position", "offset", "onset",
]
TIMING_DIRECT_KEYS = [
    "startSeconds", "start_seconds", "time", "timestamp", "seconds", "offsetSeconds", "offset_seconds",
    "onsetSeconds", "onset_seconds",
]
TIMING_NESTED_PARENTS = ["time", "start", "position", "offset", "onset"]
TIMING_NESTED_KEYS = [
    "seconds", "timeSeconds", "time_seconds", "startSeconds", "start_seconds", "offsetSeconds", "offset_seconds",
    "value",
]
LABEL_KEYS = ["lane", "label", "sourceLabel", "source_label", "instrument", "class", "type", "name"]
LABEL_NESTED_PARENTS = ["instrument", "class", "lane", "source", "drum"]
LABEL_NESTED_KEYS = ["label", "name", "id", "family", "instrument"]
EVENT_COUNT_KEYS = [
    "drumEvents", "drum_events", "drumEventCandidates", "drum_event_candidates", "events", "hits", "notes",
    "candidates",
]
EVENT_COUNT_CONTAINERS = ["drums", "percussion", "timing", "transcription"]
STAGE_EVENT_KEYS = [
    "drumEvents", "drum_events", "events", "hits", "notes", "candidates", "predictions", "detections",
]
WRAPPER_CONTAINERS = ["result", "output", "payload", "data", "response", "prediction"]
PAYLOAD_CONTAINERS = ["result", "output", "payload", "data"]
PROVENANCE_KEYS = [
    "backend", "selectedBackend", "backendCommand", "primaryBackend", "primaryBackendCommand",
    "fallbackBackendCommand", "fallbackUsed", "fallbackReason", "mode", "model", "eventBackendUsed",
    "eventBackendCommand",
]
NOTABLE_WARNINGS = ["heuristic", "Dropped ", "Collapsed ", "Reduced ", "Quantization drift"]
