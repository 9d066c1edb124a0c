"""Literal source files that the extraction queries and tests read."""

ROUTES_PHP = r"""<?php
use App\Http\Controllers\{OrderController, HomeController as Home};
use App\Http\Middleware\Audit;
use Illuminate\Support\Facades\Route;

Route::get('/', Home::class)->name('home');
Route::middleware(['auth', Audit::class])->prefix('admin')->name('admin.')->group(function () {
    Route::get('/orders/{id}', [OrderController::class, 'show'])->name('orders.show')->middleware('can:view');
    Route::group(['prefix' => 'deep', 'as' => 'deep.', 'middleware' => 'throttle:(60)'], function () {
        Route::match(['get', 'post'], 'x', 'Legacy@go');
        Route::post('/y', function () { foo(1); return (2); })->name('y');
    });
    Route::controller(OrderController::class)->group(function () {
        Route::delete('/z', 'remove');
    });
    Route::resource('photos.comments', OrderController::class, ['only' => ['index', 'show']])->shallow();
});
Route::apiResource('people-lists', 'App\Plain')->except(['destroy'])->names(['index' => 'all'])->parameters(['people-lists' => 'who']);
Route::view('/about', 'pages.about');
Route::get($dynamic, [OrderController::class, 'show']);
Route::redirect('/old', '/new');
"""

PROVIDER_PHP = r"""<?php
namespace App\Providers;
use App\Models\{Order, User};
use App\Contracts\Pay;
use Illuminate\Support\Facades\{Event, Gate};
class AppProvider extends Base
{
    protected $listen = [
        Placed::class => [SendMail::class, Log\Write::class],
        Gone::class => [],
    ];
    protected $policies = [Order::class => OrderPolicy::class];
    public function register()
    {
        $this->app->bind(Pay::class, fn ($app) => new StripePay(config('a(b')));
        $this->app->singleton('cart', \App\Cart::class);
        app()->scoped(Clock::class);
        app()->bindIf(Nope::class);
        $this->app->bind('App\Old', 'App\\New');
        $this->app->when(Order::class)->needs(Pay::class)->give(CardPay::class);
    }
    public function boot()
    {
        User::observe(UserObserver::class);
        Event::listen(Shipped::class, Notify::class);
        Gate::policy(User::class, UserPolicy::class);
    }
}
"""

MODEL_PHP = r"""<?php
namespace App\Models;
use Illuminate\Database\Eloquent\Model;
use Illuminate\Database\Eloquent\Casts\Attribute;
#[ObservedBy([OrderObserver::class, \App\Audit::class])]
class Order extends Model
{
    protected $casts = ['a' => 'int', 'b' => Money::class];
    protected function casts(): array { return ['a' => 'bool', 'd' => 'date']; }
    public function lines() { return $this->hasMany(Line::class); }
    public function tags() { return $this->belongsToMany(Tag::class, 'order_tag'); }
    public function owner() { return $this->morphTo(); }
    public function scopeOpenOnes($q) { return $q; }
    public function getTotalAttribute() { return 1; }
    protected function fullName(): Attribute { return 2; }
}
"""

FACADE_PHP = r"""<?php
namespace App\Facades;
class Cart extends \Illuminate\Support\Facades\Facade
{
    protected static function getFacadeAccessor() { return 'cart'; }
}
class Web extends Controller
{
    public function __construct() { $this->middleware('auth'); $this->middleware('can:x'); }
}
"""

PAGE_BLADE = r"""@extends('layouts.app')
{{-- @include('never') --}}
@includeWhen(count([1, (2)]) > 1, 'parts.list', ['a' => 1])
@includeFirst(['parts.own', "parts.shared"])
@include($dynamic) @@include('escaped')
<x-alert type="x"/> <x-slot name="y"></x-slot> <x-forms.field/>
<a href="{{ route('home') }}">home</a>
@verbatim @include('raw') @endverbatim
"""

FILES = [("routes/web.php", ROUTES_PHP), ("app/Providers/AppProvider.php", PROVIDER_PHP), ("app/Models/Order.php", MODEL_PHP), ("app/Facades/Cart.php", FACADE_PHP), ("resources/views/pages/about.blade.php", PAGE_BLADE), ("resources/views/components/forms/field.blade.php", "<input>"), ("empty.php", "")]
