"""Schemas of network definitions."""

STATION = "net_id string, id string, name string, label string, kind string, label_pos string, planned boolean, hidden boolean, pill_with string"
LINE = "net_id string, line_id string, line_pos int, color string, start int, anchor struct<x:double,y:double>, spacing double, direction string, closed boolean, family string, branch_of string"
PATH = "struct<length:double,minimum:double,maximum:double,flexibility:boolean,flex:double,`group`:string>"
STEP = f"net_id string, line_id string, pos int, step_kind string, station_id string, turn_delta int, turn_radius double, path {PATH}"
CORRIDOR = "net_id string, name string, corridor_pos int, steps array<string>, offsets map<string,double>, start_offsets map<string,double>, radius_from_centre boolean, radius_at map<string,double>, radii map<string,double>, immediate boolean, shift_at string"
TRAIN_GROUP = "net_id string, line_id string, pos int, kind string, route string, cars int, hollow int, note string, note_cars int"
ELEMENT = (
    "struct<type:string,id:bigint,lon:double,lat:double,tags:map<string,string>,geometry:array<struct<lon:double,lat:double>>,"
    "members:array<struct<type:string,ref:bigint,role:string,geometry:array<struct<lon:double,lat:double>>>>>"
)
OSM = f"elements array<{ELEMENT}>, remark string"
