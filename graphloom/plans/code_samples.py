"""Source files in many languages, `{k}` standing for a number, and what a reader finds in them.

A line is N|id|label|file type|@ if it is of the file|line, E|source|target|relation|confidence|line, or
C|caller|callee|is a member call|receiver|line.
"""

SAMPLES = {
    "js": (
        "src/n{k}/page.ts",
        r"""import { Base } from "./base{k}";
export * from "./more{k}";
// class Comment { }
export class Page{k} extends Base<T> implements Shown, Saved {
  private text = "class Fake {";
  draw(at: number, box: { wide: string }): void {
    const edge = (z) => { helper(z); };
    if (at) { this.fill(); pen.stop(); }
  }
  async load() { await fetchAll({ then: () => { done({k}); } }); }
}
function make{k}(a) { return new Page{k}().draw(a); }
""",
        """
N|src_n{k}_page|page.ts|code|@|1
E|src_n{k}_page|base{k}|imports_from|EXTRACTED|1
E|src_n{k}_page|more{k}|re_exports|EXTRACTED|2
N|src_n{k}_page_page{k}|Page{k}|code|@|4
E|src_n{k}_page|src_n{k}_page_page{k}|contains|EXTRACTED|4
N|base|Base|code||4
E|src_n{k}_page_page{k}|base|inherits|EXTRACTED|4
N|shown|Shown|code||4
E|src_n{k}_page_page{k}|shown|implements|EXTRACTED|4
N|saved|Saved|code||4
E|src_n{k}_page_page{k}|saved|implements|EXTRACTED|4
N|src_n{k}_page_page{k}_draw|.draw()|code|@|6
E|src_n{k}_page_page{k}|src_n{k}_page_page{k}_draw|method|EXTRACTED|6
N|src_n{k}_page_page{k}_draw_edge|edge()|code|@|7
E|src_n{k}_page_page{k}_draw|src_n{k}_page_page{k}_draw_edge|contains|EXTRACTED|7
N|src_n{k}_page_page{k}_load|.load()|code|@|10
E|src_n{k}_page_page{k}|src_n{k}_page_page{k}_load|method|EXTRACTED|10
N|src_n{k}_page_make{k}|make{k}()|code|@|12
E|src_n{k}_page|src_n{k}_page_make{k}|contains|EXTRACTED|12
C|src_n{k}_page_page{k}_draw_edge|helper|false||7
C|src_n{k}_page_page{k}_draw|fill|true|this|8
C|src_n{k}_page_page{k}_draw|stop|true|pen|8
C|src_n{k}_page_page{k}_load|fetchAll|false||10
C|src_n{k}_page_page{k}_load|done|false||10
C|src_n{k}_page_make{k}|Page{k}|false||12
C|src_n{k}_page_make{k}|draw|true||12
""",
    ),
    "java": (
        "src/n{k}/Shop.java",
        r"""package n{k};
import java.util.List;
import shop.base{k}.Helper;
/* class Comment { } */
public class Shop{k} extends Base implements Runnable, Named {
    private int n = "{".length();
    public Shop{k}(int n) { this.n = n; }
    public int total(List<String> a) throws Failure { return helper(n) + list.size(); }
    static class Inner { void deep() { for (int i = 0; i < 3; i++) { call(i); } } }
}
interface Named { String name(); }
""",
        """
N|src_n{k}_shop|Shop.java|code|@|1
E|src_n{k}_shop|java_util_list|imports|EXTRACTED|2
E|src_n{k}_shop|shop_base{k}_helper|imports|EXTRACTED|3
N|src_n{k}_shop_shop{k}|Shop{k}|code|@|5
E|src_n{k}_shop|src_n{k}_shop_shop{k}|contains|EXTRACTED|5
N|base|Base|code||5
E|src_n{k}_shop_shop{k}|base|inherits|EXTRACTED|5
N|runnable|Runnable|code||5
E|src_n{k}_shop_shop{k}|runnable|implements|EXTRACTED|5
N|named|Named|code||5
E|src_n{k}_shop_shop{k}|named|implements|EXTRACTED|5
N|src_n{k}_shop_shop{k}_shop{k}|.Shop{k}()|code|@|7
E|src_n{k}_shop_shop{k}|src_n{k}_shop_shop{k}_shop{k}|method|EXTRACTED|7
N|src_n{k}_shop_shop{k}_total|.total()|code|@|8
E|src_n{k}_shop_shop{k}|src_n{k}_shop_shop{k}_total|method|EXTRACTED|8
N|src_n{k}_shop_shop{k}_inner|Inner|code|@|9
E|src_n{k}_shop_shop{k}|src_n{k}_shop_shop{k}_inner|contains|EXTRACTED|9
N|src_n{k}_shop_shop{k}_inner_deep|.deep()|code|@|9
E|src_n{k}_shop_shop{k}_inner|src_n{k}_shop_shop{k}_inner_deep|method|EXTRACTED|9
N|src_n{k}_shop_named|Named|code|@|11
E|src_n{k}_shop|src_n{k}_shop_named|contains|EXTRACTED|11
N|src_n{k}_shop_named_name|.name()|code|@|11
E|src_n{k}_shop_named|src_n{k}_shop_named_name|method|EXTRACTED|11
C|src_n{k}_shop_shop{k}_total|helper|false||8
C|src_n{k}_shop_shop{k}_total|size|true|list|8
C|src_n{k}_shop_shop{k}_inner_deep|call|false||9
""",
    ),
    "go": (
        "src/n{k}/tool.go",
        r"""package tool
import (
	"fmt"
	other "base{k}/lib"
)
type Tool{k} struct {
	Base
	size int
}
type Reader interface { Read() int }
func (t *Tool{k}) Do(a int) error {
	fmt.Println(a)
	return t.help(a)
}
func main() { Start(1) }
""",
        """
N|src_n{k}_tool|tool.go|code|@|1
E|src_n{k}_tool|fmt|imports|EXTRACTED|3
E|src_n{k}_tool|base{k}_lib|imports|EXTRACTED|4
N|src_n{k}_tool_tool{k}|Tool{k}|code|@|6
E|src_n{k}_tool|src_n{k}_tool_tool{k}|contains|EXTRACTED|6
N|base|Base|code||7
E|src_n{k}_tool_tool{k}|base|embeds|EXTRACTED|7
N|src_n{k}_tool_reader|Reader|code|@|10
E|src_n{k}_tool|src_n{k}_tool_reader|contains|EXTRACTED|10
N|src_n{k}_tool_tool{k}_do|.Do()|code|@|11
E|src_n{k}_tool_tool{k}|src_n{k}_tool_tool{k}_do|method|EXTRACTED|11
N|src_n{k}_tool_main|main()|code|@|15
E|src_n{k}_tool|src_n{k}_tool_main|contains|EXTRACTED|15
C|src_n{k}_tool_tool{k}_do|Println|true|fmt|12
C|src_n{k}_tool_tool{k}_do|help|true|t|13
C|src_n{k}_tool_main|Start|false||15
""",
    ),
    "rust": (
        "src/n{k}/point.rs",
        r"""use std::io;
pub struct Point{k} { x: i32 }
trait Shape: Named { fn area(&self) -> i32; }
impl Shape for Point{k} { fn area(&self) -> i32 { let c = '{'; match self.x { _ => grow(self.x) } } }
mod inner { pub fn hide<'a>(x: &'a str) { super::show(1); Point{k}::fresh(); } }
""",
        """
N|src_n{k}_point|point.rs|code|@|1
E|src_n{k}_point|std_io|imports|EXTRACTED|1
N|src_n{k}_point_point{k}|Point{k}|code|@|2
E|src_n{k}_point|src_n{k}_point_point{k}|contains|EXTRACTED|2
N|src_n{k}_point_shape|Shape|code|@|3
E|src_n{k}_point|src_n{k}_point_shape|contains|EXTRACTED|3
N|named|Named|code||3
E|src_n{k}_point_shape|named|inherits|EXTRACTED|3
N|src_n{k}_point_shape_area|.area()|code|@|3
E|src_n{k}_point_shape|src_n{k}_point_shape_area|method|EXTRACTED|3
E|src_n{k}_point_point{k}|src_n{k}_point_shape|implements|EXTRACTED|4
N|src_n{k}_point_point{k}_area|.area()|code|@|4
E|src_n{k}_point_point{k}|src_n{k}_point_point{k}_area|method|EXTRACTED|4
N|src_n{k}_point_inner|inner|code|@|5
E|src_n{k}_point|src_n{k}_point_inner|contains|EXTRACTED|5
N|src_n{k}_point_inner_hide|.hide()|code|@|5
E|src_n{k}_point_inner|src_n{k}_point_inner_hide|method|EXTRACTED|5
C|src_n{k}_point_point{k}_area|grow|false||4
C|src_n{k}_point_inner_hide|show|true|super|5
C|src_n{k}_point_inner_hide|fresh|true|Point{k}|5
""",
    ),
    "cs": (
        "src/n{k}/Card.cs",
        r"""using System.Text;
namespace Deck{k} {
  public class Card : Base, IThing {
    public int Rank { get; set; }
    public Card(int a) : base(a) { }
    public void Move(string s) { Helper(s); foreach (var x in s) { x.Go(); } }
    int Cost() => 3;
    class Back { void Turn() { Move("a{"); } }
  }
}
""",
        """
N|src_n{k}_card|Card.cs|code|@|1
E|src_n{k}_card|system_text|imports|EXTRACTED|1
N|src_n{k}_card_card|Card|code|@|3
E|src_n{k}_card|src_n{k}_card_card|contains|EXTRACTED|3
N|base|Base|code||3
E|src_n{k}_card_card|base|inherits|EXTRACTED|3
N|ithing|IThing|code||3
E|src_n{k}_card_card|ithing|implements|EXTRACTED|3
N|src_n{k}_card_card_card|.Card()|code|@|5
E|src_n{k}_card_card|src_n{k}_card_card_card|method|EXTRACTED|5
N|src_n{k}_card_card_move|.Move()|code|@|6
E|src_n{k}_card_card|src_n{k}_card_card_move|method|EXTRACTED|6
N|src_n{k}_card_card_cost|.Cost()|code|@|7
E|src_n{k}_card_card|src_n{k}_card_card_cost|method|EXTRACTED|7
N|src_n{k}_card_card_back|Back|code|@|8
E|src_n{k}_card_card|src_n{k}_card_card_back|contains|EXTRACTED|8
N|src_n{k}_card_card_back_turn|.Turn()|code|@|8
E|src_n{k}_card_card_back|src_n{k}_card_card_back_turn|method|EXTRACTED|8
C|src_n{k}_card_card_move|Helper|false||6
C|src_n{k}_card_card_move|Go|true|x|6
C|src_n{k}_card_card_back_turn|Move|false||8
""",
    ),
    "c": (
        "src/n{k}/kite.cpp",
        r"""#include "kite{k}.h"
namespace sky {
class Kite : public Base { public: void rise(); int high() const { return wind(); } };
}
void Kite::rise() { line->run(); let_go(1); }
int main(int argc, char** argv) { return Kite().high(); }
""",
        """
N|src_n{k}_kite|kite.cpp|code|@|1
E|src_n{k}_kite|kite{k}_h|imports|EXTRACTED|1
N|src_n{k}_kite_sky|sky|code|@|2
E|src_n{k}_kite|src_n{k}_kite_sky|contains|EXTRACTED|2
N|src_n{k}_kite_sky_kite|Kite|code|@|3
E|src_n{k}_kite_sky|src_n{k}_kite_sky_kite|contains|EXTRACTED|3
N|base|Base|code||3
E|src_n{k}_kite_sky_kite|base|inherits|EXTRACTED|3
N|src_n{k}_kite_sky_kite_high|.high()|code|@|3
E|src_n{k}_kite_sky_kite|src_n{k}_kite_sky_kite_high|method|EXTRACTED|3
N|src_n{k}_kite_sky_kite_rise|.rise()|code|@|5
E|src_n{k}_kite_sky_kite|src_n{k}_kite_sky_kite_rise|method|EXTRACTED|5
N|src_n{k}_kite_main|main()|code|@|6
E|src_n{k}_kite|src_n{k}_kite_main|contains|EXTRACTED|6
C|src_n{k}_kite_sky_kite_high|wind|false||3
C|src_n{k}_kite_sky_kite_rise|run|true|line|5
C|src_n{k}_kite_sky_kite_rise|let_go|false||5
C|src_n{k}_kite_main|Kite|false||6
C|src_n{k}_kite_main|high|true||6
""",
    ),
    "ruby": (
        "src/n{k}/cart.rb",
        r"""require 'json'
module Shop{k}
  class Cart < Base
    include Helper
    def add(a)
      if a
        put_in(a)
      end
      rows.each do |y|
        y.stop(1)
      end
    end
  end
  def self.top; call(1); end
end
""",
        """
N|src_n{k}_cart|cart.rb|code|@|1
E|src_n{k}_cart|json|imports|EXTRACTED|1
N|src_n{k}_cart_shop{k}|Shop{k}|code|@|2
E|src_n{k}_cart|src_n{k}_cart_shop{k}|contains|EXTRACTED|2
N|src_n{k}_cart_shop{k}_cart|Cart|code|@|3
E|src_n{k}_cart_shop{k}|src_n{k}_cart_shop{k}_cart|contains|EXTRACTED|3
N|base|Base|code||3
E|src_n{k}_cart_shop{k}_cart|base|inherits|EXTRACTED|3
N|helper|Helper|code||4
E|src_n{k}_cart_shop{k}_cart|helper|mixes_in|EXTRACTED|4
N|src_n{k}_cart_shop{k}_cart_add|.add()|code|@|5
E|src_n{k}_cart_shop{k}_cart|src_n{k}_cart_shop{k}_cart_add|method|EXTRACTED|5
N|src_n{k}_cart_shop{k}_top|.top()|code|@|14
E|src_n{k}_cart_shop{k}|src_n{k}_cart_shop{k}_top|method|EXTRACTED|14
C|src_n{k}_cart_shop{k}_cart_add|put_in|false||7
C|src_n{k}_cart_shop{k}_cart_add|stop|true|y|10
""",
    ),
    "lua": (
        "src/n{k}/map.lua",
        r"""local j = require("lib.json{k}")
function Map.draw(a)
  if a then paint(a) end
  pen:stop(1)
end
local function top() return 1 end -- function no()
""",
        """
N|src_n{k}_map|map.lua|code|@|1
E|src_n{k}_map|lib_json{k}|imports|EXTRACTED|1
N|src_n{k}_map_map|Map|code|@|2
N|src_n{k}_map_map_draw|.draw()|code|@|2
E|src_n{k}_map_map|src_n{k}_map_map_draw|method|EXTRACTED|2
N|src_n{k}_map_top|top()|code|@|6
E|src_n{k}_map|src_n{k}_map_top|contains|EXTRACTED|6
C|src_n{k}_map_map_draw|paint|false||3
C|src_n{k}_map_map_draw|stop|true|pen|4
""",
    ),
    "kotlin": (
        "src/n{k}/Bird.kt",
        r"""import wild.base{k}.Nest
class Bird(val x: Int) : Base(x), Named {
  fun fly(a: Int): Int { return when (a) { 1 -> up(a) else -> 0 } }
  companion object { fun make() { Bird(1) } }
}
fun String.cut() { trim() }
""",
        """
N|src_n{k}_bird|Bird.kt|code|@|1
E|src_n{k}_bird|wild_base{k}_nest|imports|EXTRACTED|1
N|src_n{k}_bird_bird|Bird|code|@|2
E|src_n{k}_bird|src_n{k}_bird_bird|contains|EXTRACTED|2
N|base|Base|code||2
E|src_n{k}_bird_bird|base|inherits|EXTRACTED|2
N|named|Named|code||2
E|src_n{k}_bird_bird|named|inherits|EXTRACTED|2
N|src_n{k}_bird_bird_fly|.fly()|code|@|3
E|src_n{k}_bird_bird|src_n{k}_bird_bird_fly|method|EXTRACTED|3
N|src_n{k}_bird_bird_make|.make()|code|@|4
E|src_n{k}_bird_bird|src_n{k}_bird_bird_make|method|EXTRACTED|4
N|src_n{k}_bird_string|String|code|@|6
N|src_n{k}_bird_string_cut|.cut()|code|@|6
E|src_n{k}_bird_string|src_n{k}_bird_string_cut|method|EXTRACTED|6
C|src_n{k}_bird_bird_fly|up|false||3
C|src_n{k}_bird_bird_make|Bird|false||4
C|src_n{k}_bird_string_cut|trim|false||6
""",
    ),
    "swift": (
        "src/n{k}/Song.swift",
        r"""import Foundation
class Song: Base, Heard { func play(_ a: Int) -> Int { return help(a) } }
extension Song { func again() { self.play({k}) } }
""",
        """
N|src_n{k}_song|Song.swift|code|@|1
E|src_n{k}_song|foundation|imports|EXTRACTED|1
N|src_n{k}_song_song|Song|code|@|2
E|src_n{k}_song|src_n{k}_song_song|contains|EXTRACTED|2
N|base|Base|code||2
E|src_n{k}_song_song|base|inherits|EXTRACTED|2
N|heard|Heard|code||2
E|src_n{k}_song_song|heard|inherits|EXTRACTED|2
N|src_n{k}_song_song_play|.play()|code|@|2
E|src_n{k}_song_song|src_n{k}_song_song_play|method|EXTRACTED|2
N|src_n{k}_song_song_again|.again()|code|@|3
E|src_n{k}_song_song|src_n{k}_song_song_again|method|EXTRACTED|3
C|src_n{k}_song_song_play|help|false||2
C|src_n{k}_song_song_again|play|true|self|3
""",
    ),
    "php": (
        "src/n{k}/User.php",
        r"""<?php
use App\\Models{k}\\Row;
class User extends Base implements Shown { use Dated; public function save($a) { $this->check($a); helper(1); } }
function top() { return new User(); }
""",
        """
N|src_n{k}_user|User.php|code|@|1
E|src_n{k}_user|app_models{k}_row|imports|EXTRACTED|2
N|src_n{k}_user_user|User|code|@|3
E|src_n{k}_user|src_n{k}_user_user|contains|EXTRACTED|3
N|base|Base|code||3
E|src_n{k}_user_user|base|inherits|EXTRACTED|3
N|shown|Shown|code||3
E|src_n{k}_user_user|shown|implements|EXTRACTED|3
N|dated|Dated|code||3
E|src_n{k}_user_user|dated|mixes_in|EXTRACTED|3
N|src_n{k}_user_user_save|.save()|code|@|3
E|src_n{k}_user_user|src_n{k}_user_user_save|method|EXTRACTED|3
N|src_n{k}_user_top|top()|code|@|4
E|src_n{k}_user|src_n{k}_user_top|contains|EXTRACTED|4
C|src_n{k}_user_user_save|check|true|$this|3
C|src_n{k}_user_user_save|helper|false||3
C|src_n{k}_user_top|User|false||4
""",
    ),
    "dart": (
        "src/n{k}/dial.dart",
        r"""import 'package:base{k}/b.dart';
class Dial extends Base implements Turned { int spin(int a) { return help(a); } void rest() async { await x.stop(1); } }
""",
        """
N|src_n{k}_dial|dial.dart|code|@|1
E|src_n{k}_dial|package_base{k}_b_dart|imports|EXTRACTED|1
N|src_n{k}_dial_dial|Dial|code|@|2
E|src_n{k}_dial|src_n{k}_dial_dial|contains|EXTRACTED|2
N|base|Base|code||2
E|src_n{k}_dial_dial|base|inherits|EXTRACTED|2
N|turned|Turned|code||2
E|src_n{k}_dial_dial|turned|implements|EXTRACTED|2
N|src_n{k}_dial_dial_spin|.spin()|code|@|2
E|src_n{k}_dial_dial|src_n{k}_dial_dial_spin|method|EXTRACTED|2
N|src_n{k}_dial_dial_rest|.rest()|code|@|2
E|src_n{k}_dial_dial|src_n{k}_dial_dial_rest|method|EXTRACTED|2
C|src_n{k}_dial_dial_spin|help|false||2
C|src_n{k}_dial_dial_rest|stop|true|x|2
""",
    ),
    "scala": (
        "src/n{k}/Stone.scala",
        r"""import rock.base{k}.Sand
class Stone(x: Int) extends Base with Heavy { def roll(a: Int): Int = { help(a); y.stop(1) } }
object Quarry { def make() = { new Stone(1) } }
""",
        """
N|src_n{k}_stone|Stone.scala|code|@|1
E|src_n{k}_stone|rock_base{k}_sand|imports|EXTRACTED|1
N|src_n{k}_stone_stone|Stone|code|@|2
E|src_n{k}_stone|src_n{k}_stone_stone|contains|EXTRACTED|2
N|base|Base|code||2
E|src_n{k}_stone_stone|base|inherits|EXTRACTED|2
N|heavy|Heavy|code||2
E|src_n{k}_stone_stone|heavy|implements|EXTRACTED|2
N|src_n{k}_stone_stone_roll|.roll()|code|@|2
E|src_n{k}_stone_stone|src_n{k}_stone_stone_roll|method|EXTRACTED|2
N|src_n{k}_stone_quarry|Quarry|code|@|3
E|src_n{k}_stone|src_n{k}_stone_quarry|contains|EXTRACTED|3
N|src_n{k}_stone_quarry_make|.make()|code|@|3
E|src_n{k}_stone_quarry|src_n{k}_stone_quarry_make|method|EXTRACTED|3
C|src_n{k}_stone_stone_roll|help|false||2
C|src_n{k}_stone_stone_roll|stop|true|y|2
C|src_n{k}_stone_quarry_make|Stone|false||3
""",
    ),
    "zig": (
        "src/n{k}/ring.zig",
        r"""const std = @import("std");
pub const Ring = struct { x: i32, pub fn get(self: Ring) i32 { return help(self.x); } };
pub fn main() void { std.start({k}); }
""",
        """
N|src_n{k}_ring|ring.zig|code|@|1
E|src_n{k}_ring|std|imports|EXTRACTED|1
N|src_n{k}_ring_ring|Ring|code|@|2
E|src_n{k}_ring|src_n{k}_ring_ring|contains|EXTRACTED|2
N|src_n{k}_ring_ring_get|.get()|code|@|2
E|src_n{k}_ring_ring|src_n{k}_ring_ring_get|method|EXTRACTED|2
N|src_n{k}_ring_main|main()|code|@|3
E|src_n{k}_ring|src_n{k}_ring_main|contains|EXTRACTED|3
C|src_n{k}_ring_ring_get|help|false||2
C|src_n{k}_ring_main|start|true|std|3
""",
    ),
    "powershell": (
        "src/n{k}/kit.ps1",
        r"""Import-Module Tools{k}
class Kit : Base { [int] Run([int]$a) { return $this.Check($a) } }
function Get-Kit($a) { Help(1) }
""",
        """
N|src_n{k}_kit|kit.ps1|code|@|1
E|src_n{k}_kit|tools{k}|imports|EXTRACTED|1
N|src_n{k}_kit_kit|Kit|code|@|2
E|src_n{k}_kit|src_n{k}_kit_kit|contains|EXTRACTED|2
N|base|Base|code||2
E|src_n{k}_kit_kit|base|inherits|EXTRACTED|2
N|src_n{k}_kit_kit_run|.Run()|code|@|2
E|src_n{k}_kit_kit|src_n{k}_kit_kit_run|method|EXTRACTED|2
N|src_n{k}_kit_get_kit|Get-Kit()|code|@|3
E|src_n{k}_kit|src_n{k}_kit_get_kit|contains|EXTRACTED|3
C|src_n{k}_kit_kit_run|Check|true|$this|2
C|src_n{k}_kit_get_kit|Help|false||3
""",
    ),
    "elixir": (
        "src/n{k}/door.ex",
        r"""defmodule House{k}.Door do
  use Wood.Base
  def shut(a) do
    push(a)
    Lock.turn(a)
  end
end
""",
        """
N|src_n{k}_door|door.ex|code|@|1
E|src_n{k}_door|wood_base|imports|EXTRACTED|2
N|src_n{k}_door_house{k}_door|House{k}.Door|code|@|1
E|src_n{k}_door|src_n{k}_door_house{k}_door|contains|EXTRACTED|1
N|src_n{k}_door_house{k}_door_shut|.shut()|code|@|3
E|src_n{k}_door_house{k}_door|src_n{k}_door_house{k}_door_shut|method|EXTRACTED|3
C|src_n{k}_door_house{k}_door_shut|push|false||4
C|src_n{k}_door_house{k}_door_shut|turn|true|Lock|5
""",
    ),
    "julia": (
        "src/n{k}/sum.jl",
        r"""using Stats{k}
struct Total <: Base
  x
end
function add(a)
  if a
    help(a)
  end
end
""",
        """
N|src_n{k}_sum|sum.jl|code|@|1
E|src_n{k}_sum|stats{k}|imports|EXTRACTED|1
N|src_n{k}_sum_total|Total|code|@|2
E|src_n{k}_sum|src_n{k}_sum_total|contains|EXTRACTED|2
N|base|Base|code||2
E|src_n{k}_sum_total|base|inherits|EXTRACTED|2
N|src_n{k}_sum_add|add()|code|@|5
E|src_n{k}_sum|src_n{k}_sum_add|contains|EXTRACTED|5
C|src_n{k}_sum_add|help|false||7
""",
    ),
    "groovy": (
        "src/n{k}/Job.groovy",
        r"""import work.base{k}.Task
class Job extends Base { def run(a) { help(a) } }
""",
        """
N|src_n{k}_job|Job.groovy|code|@|1
E|src_n{k}_job|work_base{k}_task|imports|EXTRACTED|1
N|src_n{k}_job_job|Job|code|@|2
E|src_n{k}_job|src_n{k}_job_job|contains|EXTRACTED|2
N|base|Base|code||2
E|src_n{k}_job_job|base|inherits|EXTRACTED|2
N|src_n{k}_job_job_run|.run()|code|@|2
E|src_n{k}_job_job|src_n{k}_job_job_run|method|EXTRACTED|2
C|src_n{k}_job_job_run|help|false||2
""",
    ),
    "python": (
        "src/n{k}/plan.py",
        r'''"""Plans of nation {k}."""
import os
from base{k}.lib import Tool
class Plan(Base):
    def draw(self, a):
        helper(a)
        return self.pen.stop()
def main():
    Plan().draw({k})
''',
        """
N|src_n{k}_plan|plan.py|code|@|1
N|src_n{k}_plan_rationale_1|Plans of nation {k}.|rationale|@|1
E|src_n{k}_plan_rationale_1|src_n{k}_plan|rationale_for|EXTRACTED|1
E|src_n{k}_plan|os|imports|EXTRACTED|2
E|src_n{k}_plan|base{k}_lib|imports_from|EXTRACTED|3
E|src_n{k}_plan|base{k}_lib_tool|imports|INFERRED|3
N|src_n{k}_plan_plan|Plan|code|@|4
E|src_n{k}_plan|src_n{k}_plan_plan|contains|EXTRACTED|4
N|base|Base|code||4
E|src_n{k}_plan_plan|base|inherits|EXTRACTED|4
N|src_n{k}_plan_plan_draw|.draw()|code|@|5
E|src_n{k}_plan_plan|src_n{k}_plan_plan_draw|method|EXTRACTED|5
C|src_n{k}_plan_plan_draw|helper|false||6
C|src_n{k}_plan_plan_draw|stop|true||7
N|src_n{k}_plan_main|main()|code|@|8
E|src_n{k}_plan|src_n{k}_plan_main|contains|EXTRACTED|8
C|src_n{k}_plan_main|draw|true||9
C|src_n{k}_plan_main|Plan|false||9
""",
    ),
    "sql": (
        "src/n{k}/shop.sql",
        r"""-- create table no (a int);
CREATE TABLE goods{k} (id int, shop int REFERENCES shops(id));
CREATE VIEW cheap{k} AS SELECT * FROM goods{k} JOIN prices ON true;
""",
        """
N|src_n{k}_shop|shop.sql|code|@|1
N|src_n{k}_shop_goods{k}|goods{k}|code|@|2
E|src_n{k}_shop|src_n{k}_shop_goods{k}|contains|EXTRACTED|2
E|src_n{k}_shop_goods{k}|src_n{k}_shop_shops|references|EXTRACTED|2
N|src_n{k}_shop_cheap{k}|cheap{k}|code|@|3
E|src_n{k}_shop|src_n{k}_shop_cheap{k}|contains|EXTRACTED|3
E|src_n{k}_shop_cheap{k}|src_n{k}_shop_goods{k}|reads_from|EXTRACTED|3
E|src_n{k}_shop_cheap{k}|src_n{k}_shop_prices|reads_from|EXTRACTED|3
""",
    ),
    "cargo": (
        "src/n{k}/Cargo.toml",
        r"""[package]
name = "tool{k}"
[dependencies]
serde = "1"
""",
        """
N|src_n{k}_cargo|Cargo.toml|code|@|1
N|crate_tool{k}|tool{k}|code|@|1
E|src_n{k}_cargo|crate_tool{k}|contains|EXTRACTED|1
N|crate_serde|serde|code||1
E|crate_tool{k}|crate_serde|depends_on|EXTRACTED|1
""",
    ),
}
