"""Schemas of the tables."""

DETECTIONS = "recording_id BIGINT, frame BIGINT, det_id BIGINT, x DOUBLE, y DOUBLE, width DOUBLE, height DOUBLE, degrees_angle DOUBLE, illumination DOUBLE"
TRACKS = "recording_id BIGINT, track_id BIGINT, position_t BIGINT, position_x DOUBLE, position_y DOUBLE, width DOUBLE, height DOUBLE, degrees_angle DOUBLE"
TRACK_COLUMNS = [c.split()[0] for c in TRACKS.split(", ")]
#: Columns of the CSV form, in its order.
TRACKS_CSV = "TRACK_ID BIGINT, POSITION_T BIGINT, POSITION_X DOUBLE, POSITION_Y DOUBLE, WIDTH DOUBLE, HEIGHT DOUBLE, DEGREES_ANGLE DOUBLE, ILLUMINATION DOUBLE"
RECORDINGS = "recording_id BIGINT, name STRING, recorded_at TIMESTAMP, fps DOUBLE, frame_height INT, frame_width INT, frame_count BIGINT"
METADATA = "fps DOUBLE, frame_height INT, frame_width INT, frame_count BIGINT"
KEY = ["recording_id", "track_id"]
ANALYSED_COLUMNS = [*TRACK_COLUMNS, "angle_diff", "moving", "turn_points", "tp_of_tracks", "travelled_dist", "motility_phenotype"]
