"""Sources of six languages that are valid, and some that aren't."""

VALID = {
 ".kt": ["fun f(x: Int?): Int = x ?: 0\n", '''package a.b.c

import kotlin.math.*
import a.b.C as D

@Target(AnnotationTarget.CLASS)
annotation class Fancy(val why: String)

/** Doc. */
sealed class Shape<out T : Any>(val name: String, private var n: Int = 1) : Base<T>(name), Closeable by inner {
    companion object {
        const val MAX = 10
        @JvmStatic fun of(vararg xs: Int): Shape<*> = Circle(*xs)
    }
    data class Circle(val r: Double) : Shape<Nothing>("c")
    object Empty : Shape<Nothing>("e")
    var size: Int
        get() = field + 1
        private set(value) { field = value }
    val lazyOne by lazy { compute() }
    init { require(n > 0) { "n was $n and ${name.length}" } }
    constructor(n: Int) : this("x", n)
    abstract fun area(): Double
    override suspend fun <R> map(f: suspend (T, Int) -> R?): List<R> where R : Comparable<R> {
        val (a, b) = pair
        for ((k, v) in m) println("$k = $v")
        for (i in 0 until 10 step 2) { continue }
        outer@ while (true) { break@outer }
        do { n-- } while (n > 0)
        val y = when (val s = call()) {
            is Circle, is Empty -> 1
            in 1..9 -> 2
            !in xs -> { 3 }
            "a", "b" -> 4
            else -> throw IllegalStateException("no")
        }
        val z = if (a > b) a else if (b == a) 0 else { b }
        val t = try { risky() } catch (e: IOException) { null } finally { close() }
        list.filter { it.x > 1 && it != null }
            .map { (k, v) -> k to v }
            ?.forEach { x: Int -> print(x as? Long) } ?: return emptyList()
        val g = fun(x: Int): Int { return x }
        val o = object : Runnable { override fun run() {} }
        foo(1, name = "x", *rest) { a, b -> a + b }
        x!!.y?.z++
        val ref = String::length
        run { return@run 1 }
        return mutableListOf<R>().also { it += f(x, 1)!! }
    }
}

enum class E(val x: Int) { A(1), B(2) { override fun m() = 1 }; open fun m() = 0 }
interface I { val x: Int; fun f(): Unit }
fun interface J { fun call(x: Int): Boolean }
typealias H<T> = (T) -> Unit
fun <T> List<T>.second(): T? = if (size > 1) this[1] else null
val String.shout: String get() = uppercase()
internal inline fun <reified T> q(noinline b: () -> T, crossinline c: T.() -> Unit) = T::class
val s = """raw "text" ${'$'}"""
tailrec fun g(n: Int): Int =
    if (n == 0) 1
    else g(n - 1)
''', "fun main() {\n    val x = a\n        .b()\n        .c\n    println(x)\n    val m = mapOf(1 to \"a\", 2 to \"b\")\n    m[1] = x shl 2 and 0xFF\n    if (x !is String) return\n    val l = listOf(1, 2,)\n    x?.let { print(it) }\n}\n"],
 ".swift": ["func f() -> Int { return 1 }\n", '''import Foundation
@testable import A.B

public protocol P: AnyObject, Q {
    associatedtype T: Equatable
    var x: Int { get set }
    static func f(_ a: Int, b c: String?) throws -> [T]
    init?(y: Int)
}

@objc open class C<T>: B, P where T: Hashable {
    private(set) var x: Int = 0 { didSet { print(oldValue) } }
    lazy var y: [String: Int] = [:]
    static let shared = C()
    weak var d: D?
    var z: Int {
        get { return x }
        set(v) { x = v }
    }
    var w: Int { x + 1 }
    required init?(y: Int) { super.init(); self.x = y }
    deinit { }
    subscript(i: Int) -> T { return items[i] }
    override func f<U: P>(_ a: Int = 1, b c: String?, _ rest: Int..., done: @escaping (Result<T, Error>) -> Void) async throws -> (a: Int, b: String) where U.T == T {
        guard let a = opt, a > 0, case .some(let q) = r else { throw E.bad(1) }
        if let x, x != y || !z { return (1, "s \\(x + 1) \\(f("k"))") } else if #available(iOS 13, *) { }
        for (i, v) in xs.enumerated() where i % 2 == 0 { continue }
        for case let .a(b) in list { print(b) }
        while i < 10 { i += 1 }
        repeat { i -= 1 } while i > 0
        switch v {
        case .a, .b(let x) where x > 1: fallthrough
        case let (p, q): break
        case 1...9: print("x")
        case is String: return try await g()
        default: break
        }
        do { try h() } catch let e as MyError { } catch { print(error) }
        defer { close() }
        let c = { [weak self] (a: Int, b) -> Int in return a + b }
        let m = xs.map { $0.name }.filter { !$0.isEmpty }
            .sorted(by: <)
        let t = a ? b : c ?? d!
        items.forEach { item in
            item?.run()
        }
        UIView.animate(withDuration: 1) { } completion: { _ in }
        let k = \\Foo.bar
        let arr = [Int](repeating: 0, count: 3)
        let d: [String: [Int]] = ["a": [1, 2], "b": []]
        x = try? y as? Z
        return self.a.b![0]?.c
    }
}

enum E: Error, CaseIterable { case a, b(Int, s: String); case c = "x"; indirect case d(E)
  var n: Int { switch self { case .a: return 1; default: return 2 } } }
struct S { let x: Int; var y = 1, z: String?; mutating func m() { self = S(x: 1) } }
extension Array where Element == Int { func sum() -> Int { reduce(0, +) } }
extension C.D: P {}
typealias H = (Int) -> Void
let v = """
  multi "quoted"
  """
#if DEBUG
let q = 1
#endif
actor Bank { nonisolated let id: Int = 1 }
infix operator **: MultiplicationPrecedence
func ** (a: Int, b: Int) -> Int { a }
'''],
 ".sol": ["contract C { function f() public pure returns (uint) { return 1; } }\n", '''// SPDX-License-Identifier: MIT
pragma solidity ^0.8.0;
import {A as B} from "./a.sol";
import "b.sol";

error Bad(address who, uint256 n);
library L { function f(uint[] storage a) internal view returns (uint) { return a.length; } }
interface I { function g(bytes calldata d) external payable returns (bool ok, bytes memory out); event X(address indexed a, uint b); }
abstract contract C is A("x"), I {
    using L for uint[];
    struct S { uint a; mapping(address => mapping(uint => bool)) m; }
    enum E { One, Two }
    mapping(address owner => uint) public override balances;
    uint256 public constant MAX = 10 ** 18;
    address payable immutable owner;
    function(uint) external returns (uint) fp;
    event Done(address indexed a);
    modifier only(address a) { require(msg.sender == a, "no"); _; }
    constructor(uint x) A(x) payable { owner = payable(msg.sender); }
    receive() external payable {}
    fallback() external {}
    function f(uint a, S memory s) public virtual override(A, I) only(owner) returns (uint, bool) {
        uint[] memory xs = new uint[](3);
        (bool ok, bytes memory data) = to.call{value: 1 ether, gas: 5000}("");
        (a, ) = (1, 2);
        if (!ok) revert Bad({who: to, n: a}); else { a++; }
        for (uint i = 0; i < xs.length; i++) { if (i == 2) continue; xs[i] = i % 2 == 0 ? i << 1 : ~i; }
        while (a > 0) a--;
        do { a += 1; } while (a < 5);
        unchecked { a -= 1; }
        try this.g(data) returns (bool r, bytes memory) { emit Done(msg.sender); } catch Error(string memory reason) { revert(reason); } catch { }
        assembly { let x := mload(0x40) if iszero(x) { revert(0, 0) } }
        delete balances[msg.sender];
        s.m[msg.sender][1] = true;
        bytes4 sel = this.f.selector;
        uint m = type(uint).max;
        string memory t = string(abi.encodePacked("a", hex"00ff", data[1:3]));
        return (a, ok && a >= 1 days);
    }
}
'''],
 ".zig": ["pub fn f(x: u8) !void { return x; }\n", '''const std = @import("std");
const Allocator = std.mem.Allocator;
pub const Error = error{ OutOfMemory, Bad } || OtherError;
threadlocal var counter: usize = 0;
extern "c" fn puts(s: [*:0]const u8) c_int;
/// Doc
pub fn List(comptime T: type) type {
    return struct {
        const Self = @This();
        items: []T = &.{},
        len: usize,
        next: ?*Self = null,
        pub fn init(a: Allocator, n: usize) !Self {
            var self = Self{ .items = try a.alloc(T, n), .len = 0 };
            errdefer a.free(self.items);
            defer _ = counter + 1;
            return self;
        }
    };
}
const Color = enum(u8) { red = 1, green, _, pub fn f(c: Color) bool { return c == .red; } };
const U = union(enum) { a: u32, b: []const u8, none };
pub fn main() anyerror!void {
    const x: i32 = if (a > b) a else b;
    var arr = [_]u8{ 1, 2, 3 };
    const s = arr[0..2];
    for (arr, 0..) |*v, i| { v.* += @intCast(i); }
    while (it.next()) |item| : (i += 1) { if (item == null) continue; }
    const y = switch (c) { .red, .green => 1, 'a'...'z' => |v| v, else => { return error.Bad; } };
    const z = foo() catch |err| switch (err) { error.Bad => return, else => unreachable };
    const w = opt orelse return null;
    if (opt) |v| { use(v); } else |e| { log(e); }
    const blk = blk: { break :blk 5; };
    outer: while (true) { break :outer; }
    inline for (fields) |f| { _ = f; }
    std.debug.print("{d} {s}\\n", .{ x, "a" });
    const t = .{ .a = 1, .b = "x" };
    const p: *const fn (u8, []const u8) void = &handler;
    const m =
        \\\\line one
        \\\\line two
    ;
    comptime { assert(@sizeOf(T) == 4); }
    x = y +% 1 << 2 & 0xff;
    ptr.?.field = undefined;
    try list.append(a, .{ .x = 1 });
    return;
}
test "name" { try std.testing.expect(1 + 1 == 2 and true or !false); }
'''],
 ".php": ["<html><?php if ($a) { echo \"x\"; } ?></html>", '''<?php
declare(strict_types=1);
namespace App\\Models;

use Foo\\{Bar, Baz as Q};
use function a\\b;
use X\\Y as Z, W;

#[Attribute(flags: 1)]
final class User extends Model implements \\JsonSerializable, Countable
{
    use HasName, HasAge { HasName::x insteadof HasAge; }
    public const A = 1, B = self::A . 'x';
    private ?string $name = null;
    protected static array $list = ['a' => 1, 'b' => [1, 2, ...$rest]];
    public readonly int|float $n;
    public function __construct(private readonly string $a, protected int &$b = 1, ?Foo ...$rest) { parent::__construct($a); }
    abstract protected function f(): static;
    public static function &make(array $x = [], callable $f = null): ?self
    {
        foreach ($x as $k => [$a, $b]) { continue 2; }
        foreach ($list as &$v): echo $v; endforeach;
        for ($i = 0, $j = 1; $i < 10; $i++) if ($i % 2): print $i; elseif ($j): else: break; endif;
        while (true) { break; }
        do { $x--; } while ($x > 0);
        switch ($x) { case 1: case 'a'; return 1; default: throw new \\Exception("no {$x['a']} $y->z"); }
        try { risky(); } catch (A | B $e) { } finally { close(); }
        $f = function ($x) use (&$y, $z): int { return $x; };
        $g = fn(int $x) => $x ** 2;
        $h = static fn() => yield 1;
        $m = match (true) { $a > 1, $b => 'x', default => throw new E() };
        $o = new class($x) extends Foo { public $y; };
        $v = $a ?? $b?->c()?->d[0] ?: (int) $z;
        $s = <<<EOT
  text $x {$y}
  EOT;
        list($a, , $b) = [1, 2, 3];
        [$a, 'k' => $b] = $arr;
        $obj->{$name}->$prop['x'](...$args)::CONST;
        $x = isset($a, $b) && !empty($c) || $d instanceof Foo and true;
        static $cache = [];
        global $q;
        unset($a[1], $b);
        echo "a", 'b' . PHP_EOL;
        strlen(...);
        foo(name: 1, other: [1]);
        @include_once __DIR__ . '/x.php';
        return clone $this;
    }
}
enum Suit: string { case Hearts = 'H'; const X = self::Hearts; public function label(): string { return ucfirst($this->value); } }
interface I { public function a(int $x): void; }
trait T { private $x; }
function gen() { $x = yield $k => $v; yield from other(); }
if ($a) : ?>
<p><?= $x ?></p>
<?php endif;
$$name = `ls`;
$x .= $y <=> $z;
goto end;
end:
'''],
 ".rb": ["class A\n  def f(x)\n    return 1 if x\n    y.each do |z|\n      puts z\n    end\n  end\nend\n", '''# frozen_string_literal: true
require 'set'
require_relative "x/y"

module Foo::Bar
  VERSION = "1.0".freeze
  class Error < StandardError; end
  class << self
    attr_accessor :name, :age
    def [](k) = @h[k]
    def ==(other) = other.is_a?(self.class) && other.x == x
  end

  class Thing < Struct.new(:a, :b)
    include Comparable
    private_constant :X
    attr_reader :size
    def initialize(a, b = nil, *rest, key:, opt: 1, **kw, &block)
      super(a, b)
      @a, @b = a, b
      @h ||= Hash.new { |h, k| h[k] = [] }
      self.size = rest.map(&:to_i).sum
    end

    def run!
      items.each_with_index do |(x, y), i|
        next unless x
        puts "item #{x} #{y[:k]} #{"nested"}" if i > 1 && !y.nil?
      end
      result = case kind
               when :a, "b" then 1
               when Integer, /re+x/i
                 2
               else 3
               end
      begin
        risky
      rescue ArgumentError, TypeError => e
        raise Error, "bad: #{e.message}"
      rescue
        retry
      else
        ok
      ensure
        close
      end
      x = if a > b then a else b end
      y = a ? b : c
      until done? do step end
      while (line = gets)
        break if line =~ /^q/
      end
      for i in 0..10
        print i
      end
      hash = { a: 1, "b" => 2, :c => [1, *more], **rest, d: -> { 1 }, e: ->(x, y = 2) { x + y } }
      foo a, b: 1 do |q; local|
        q
      end
      list
        .select { |v| v.odd? }
        .map(&:to_s)
        .join(", ")
      text = <<~EOS
        hello #{name}
        if unless end
      EOS
      call(<<-A, 1)
        x
      A
      a, (b, c), *d = list
      a&.b ||= %w[x y z]
      return a, b unless defined?(foo)
      puts [1, 2].inspect, -1
      yield x, y if block_given?
      obj.method :sym, key: val
      value = a + b *
        c
      assert_equal 1, x
      expect { foo }.to raise_error(Error)
      raise "x" unless a and not b
      z = [
        1,
        2,
      ]
      $stdout.puts x
      p(*args, **opts, &blk)
      when_x = 1
      @x = y rescue nil
      case [1, [2]]
      in [Integer => a, [b]] if a > 0
        a
      in {name: String => n}
        n
      end
    end

    def self.create(*args) = new(*args)
    private def helper; end
    protected
    def <=>(o)
      a <=> o.a
    end
    alias to_str to_s
    def x=(v)
      @x = v
    end
  end
end

if __FILE__ == $0
  Foo::Bar::Thing.new(1, key: 2).run!
end
Gem::Specification.new do |s|
  s.name = "x"
  s.files = Dir["lib/**/*.rb"]
  s.add_dependency "y", "~> 1.0"
end
task default: [:test]
task :test => :build do
  sh "x"
end
__END__
anything ( here
'''],
}
INVALID = {
 ".kt": ["fun f( { }", "class A { fun f() { return (1 } }", "fun f() { val x = }", "fun f() {\n  if (x { }\n}", "class A {", "fun f() { \"abc }", "def f(x):\n    return 1\n", "<<<<<<< HEAD\nfun a() {}\n=======\n", "fun f() { a b c d }x(", "val x: = 1", "fun f() { when (x) { 1 -> } }", "class { }"],
 ".swift": ["func f() { return (1 }", "func f( { }", "let x = ", "class A { func f() { }", "if x { ", "struct S { let x Int }", "let s = \"abc", "def f(x):\n    return 1\n", "guard x { }", "func f() -> { }", "for x xs { }", "<<<<<<< HEAD\nlet a = 1\n"],
 ".sol": ["contract C { function f( }", "contract C { uint x }", "contract C { function f() public { return 1 } }", "contract C {", "contract C { function f() { uint x = ; } }", "contract C { mapping(address = uint) m; }", "def f(): pass", "contract C { string s = \"abc; }", "contract C { function f() { if (x { } } }", "contract { }"],
 ".zig": ["fn f() void { \"abc }", "fn f( void {}", "const x = ;", "fn f() void { const x = 1 }", "pub fn f() void {", "fn f() void { if (x { } }", "def f(): pass", "const x: = 1;", "fn f() void { return 1 2; }", "let x = 1;"],
 ".php": ["<?php function f( { }", "<?php $x = ;", "<?php if ($a) { echo 1;", "<?php echo 1 echo 2;", "<?php class A { public function f( { } }", "<?php $x = 'abc;", "<?php foreach ($a $b) {}", "<?php class A { $x; }", "<?php return }", "<?php $a = [1, 2;", "<?php match ($x) { 1 => }"],
 ".rb": ["class A\n  def f\n  end\n", "def f(\n  1\nend\n", "x = \n", "foo(1\n", "if x\n  y\n", "end\n", "def f\n  \"abc\nend\n", "class\nend\n", "x = [1, 2\n", "case x\nend\n", "foo do |x\nend\n", "a = {b: 1\n", "<<<<<<< HEAD\nx = 1\n=======\n", "1 2\n"],
}
