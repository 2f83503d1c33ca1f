"""Schemas of the tables that operators read and write."""

from __future__ import annotations

#: The fact table: one box of one track in one frame.  (x, y) is the top-left corner, y grows downward.
DETECTIONS = "video_id bigint, track_id bigint, det_id bigint, frame_id bigint, x double, y double, width double, height double, confidence double"
#: A detector's output before linking.
RAW_DETECTIONS = "video_id bigint, det_id bigint, frame_id bigint, x double, y double, width double, height double, confidence double, class_id int"
VIDEOS = "video_id bigint, width double, height double, fps double, total_frames bigint"
LOS = "video_id bigint, slope double, intercept double, x_value double, confidence double"
ROUTES = "route_id bigint, route_type string, source string, x_coords array<double>, y_coords array<double>"
LABELS = "track_id bigint, source_video string, route_type string, labeler string, confidence int, notes string"
#: One file of trajectories; unknown fields are dropped and missing ones are null.
TRAJECTORY_FILE = (
    "metadata struct<num_trajectories:bigint,total_detections:bigint,average_detections:double,frames_processed:bigint,"
    "processing_time_seconds:double,total_camera_motion_pixels:double>, "
    "trajectories array<struct<track_id:bigint,num_detections:bigint,frame_range:array<bigint>,total_distance:double,displacement:double,"
    "video_width:double,video_height:double,team:string,position:string,is_skill_position:boolean,"
    "detections:array<struct<frame_id:bigint,x:double,y:double,width:double,height:double,center_x:double,center_y:double,confidence:double>>>>, "
    "_corrupt_record string"
)
